"""DuckDB SQL of the registered queries, over views of the same tables."""

from __future__ import annotations

#: Edge cases of answers, dealt to documents by number.
YES_NO = ("", "  Yes.", "no\nyes", "Well, yes", "Nothing", "maybe", "It is no.", "YES", "No, wait", "so\nYes", "Yesterday", "a.no,b")
THREE = ("True", "FALSE.", "unsure", "I think true", "Uncertain", "", "it is, false", "\n true", "Unsure, true", "no")
ZERO_SHOT = ("reason\nYes.", "yes because", "Answer: No", "none", "", "It is\n No \n\n", "Perhaps Yes it is\nhm", "no.")
JSON = ('{"lesson": "Read on."}', 'So: {"lesson": " Trim me ", "when": "x"} ok', "```json\n{\"lesson\": \"fenced\"}\n```", '{"when": "x"}', "nothing", '{"lesson": ""}', '["lesson"]')

MATCH = ('{"match": true}', '{"match": "Unsure"}', ' {"match": false} ', "It is true", "false, not true", "unsure or true", "no idea", '{"match": true', '{"other": 1}', "")
FLAT = ('{"condition": " Is red. "}', '```json\n{"condition": "Fenced."}\n```', 'Sure: {"condition": "In prose."} and more', "nothing", '{"other": "x"}', '{"condition": ""}')
TRUTHY = ("Yes", "No", "yes", " 1 ", "TRUE", "UNKNOWN", "0", "")

_Q = "(0,'is_english','The document is written in English.'),(1,'long_doc','The document has more than 1000 characters.'),(2,'has_digit','The document holds a digit.'),(3,'high_quality','The document is of high quality.'),(4,'toxic','The document is toxic.')"

BASE = f"""WITH q(qid, query_name, query_description) AS (VALUES {_Q}),
pts AS (SELECT d.doc_id, d.text, d.n_chars, q.qid, q.query_name, q.query_description, d.doc_id*8+q.qid AS pos,
  CASE q.qid WHEN 0 THEN d.lang='en' WHEN 1 THEN d.n_chars>1000 WHEN 2 THEN regexp_matches(d.text,'[0-9]') WHEN 3 THEN l.quality=1 ELSE l.toxic=1 END AS truth
  FROM documents d LEFT JOIN labels l USING (doc_id) CROSS JOIN q),
points AS (SELECT *, CASE WHEN truth THEN 'Yes' ELSE 'No' END AS ground_truth, (doc_id*7919+qid*104729+17)%1000 AS h, (doc_id*31+qid*17)%100 AS g FROM pts WHERE truth IS NOT NULL),
s0 AS (SELECT *, CASE WHEN h<150 THEN NOT truth ELSE truth END AS says, -(h%50)/100.0::DOUBLE AS lp_top, n_chars//4+25 AS small_in, 1::BIGINT AS small_out FROM points),
s1 AS (SELECT *, lp_top-(2+h%40)/10.0::DOUBLE AS lp_alt, CASE WHEN h>=150 AND h<250 THEN lp_top+0.5::DOUBLE ELSE lp_top-3.0::DOUBLE END AS lp_unsure FROM s0),
s2 AS (SELECT *, CASE WHEN says THEN lp_top ELSE lp_alt END AS lp_yes, CASE WHEN says THEN lp_alt ELSE lp_top END AS lp_no FROM s1),
s3 AS (SELECT *, exp(lp_yes-greatest(lp_yes,lp_no,lp_unsure)) AS ey, exp(lp_no-greatest(lp_yes,lp_no,lp_unsure)) AS en, exp(lp_unsure-greatest(lp_yes,lp_no,lp_unsure)) AS eu FROM s2),
s4 AS (SELECT *, ey/(ey+en+eu) AS p_yes, en/(ey+en+eu) AS p_no, eu/(ey+en+eu) AS p_unsure FROM s3),
small AS (SELECT *, CASE WHEN p_yes>=p_no AND p_yes>=p_unsure THEN 'Yes' WHEN p_no>=p_unsure THEN 'No' ELSE 'Unsure' END AS small_prediction,
  greatest(p_yes,p_no) AS confidence, abs(p_yes-p_no) AS margin, CASE WHEN (CASE WHEN g<5 THEN NOT truth ELSE truth END) THEN 'Yes' ELSE 'No' END AS large_all,
  -(p_yes/(p_yes+p_no)*ln(p_yes/(p_yes+p_no)) + p_no/(p_yes+p_no)*ln(p_no/(p_yes+p_no))) AS entropy_2way, -(p_yes*ln(p_yes)+p_no*ln(p_no)+p_unsure*ln(p_unsure)) AS entropy_3way FROM s4),
dec AS (SELECT *, small_prediction IN ('UNKNOWN','Unsure') OR confidence<0.8 AS escalated FROM small),
rec AS (SELECT *, CASE WHEN escalated THEN large_all END AS large_prediction, CASE WHEN escalated THEN large_all ELSE small_prediction END AS prediction FROM dec),
met AS (SELECT *, escalated::BIGINT AS verify_calls, CASE WHEN escalated THEN small_in*2 ELSE 0 END AS verify_in, escalated::BIGINT AS verify_out, CASE WHEN escalated THEN small_in+40 ELSE 0 END AS large_in, escalated::BIGINT AS large_out FROM rec),
nv AS (SELECT count(*) AS n FROM embeddings),
dv AS (SELECT d.doc_id, e.embedding::DOUBLE[] AS vec FROM documents d CROSS JOIN nv JOIN embeddings e ON e.vec_id = d.doc_id % nv.n),
les AS (SELECT printf('exp_%03d', b.item_id::BIGINT) AS experience_id, ['is_english','long_doc','has_digit','high_quality','toxic'][b.item_id%5+1] AS source_query, b.item_id*3 AS source_doc_id, b.text AS experience_text, e.embedding::DOUBLE[] AS vec
  FROM benchmark b JOIN embeddings e ON e.vec_id=b.item_id),
dc AS (SELECT dv.doc_id, les.experience_id, les.source_query, les.source_doc_id, list_dot_product(dv.vec, les.vec) AS cos FROM dv CROSS JOIN les),
dr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cos DESC, experience_id)-1 AS rank FROM dc)
"""


def _values(values: tuple[str, ...]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _edge(values: tuple[str, ...]) -> str:
    return f"WITH e AS (SELECT doc_id, ({_values(values)})[doc_id%{len(values)}+1] AS raw FROM documents), l AS (SELECT *, lower(trim(split_part(trim(raw, E' \\n'), E'\\n', 1))) AS line FROM e) "


def _ratios(prediction: str, keys: str, source: str) -> str:
    k = keys + ", " if keys else ""
    by = f" GROUP BY {keys}" if keys else ""
    return f"""c AS (SELECT {k}count(*) FILTER ({prediction}='Yes' AND ground_truth='Yes') AS tp, count(*) FILTER ({prediction}='Yes' AND ground_truth='No') AS fp, count(*) FILTER ({prediction}='No' AND ground_truth='No') AS tn,
  count(*) FILTER ({prediction}='No' AND ground_truth='Yes') AS fn, count(*) FILTER ({prediction}='UNKNOWN') AS parse_fail, count(*) FILTER ({prediction} NOT IN ('Yes','No','UNKNOWN')) AS n_other FROM {source}{by}),
m AS (SELECT {k}tp, fp, tn, fn, parse_fail, n_other, tp+fp+tn+fn AS n, round(coalesce((tp+tn)/nullif(tp+fp+tn+fn,0),0)::DOUBLE,6) AS accuracy, round(coalesce(tp/nullif(tp+fp,0),0)::DOUBLE,6) AS precision,
  round(coalesce(tp/nullif(tp+fn,0),0)::DOUBLE,6) AS recall, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0)::DOUBLE,6) AS f1 FROM c)"""


_ESC = "x AS (SELECT query_name, count(*) AS n_points, count(*) FILTER (escalated) AS n_escalated, round(avg(escalated::INT),6) AS escalation_rate FROM rec GROUP BY query_name)"
_PER_QUERY = f"{BASE}, {_ratios('prediction', 'query_name', 'rec')}, {_ESC} SELECT m.*, n_points, n_escalated, escalation_rate FROM m JOIN x USING (query_name)"
_CACHE = """, dd AS (SELECT *, CASE WHEN doc_id%29=0 THEN 'x'||doc_id ELSE doc_id::VARCHAR END AS did FROM documents),
raw_rows AS (SELECT did, CASE WHEN lang='en' THEN 'Yes' ELSE 'No' END AS prediction, 'first' AS raw, 1 AS source_no, n_chars AS line_no FROM dd WHERE doc_id%3<>0
  UNION ALL SELECT did, CASE WHEN doc_id%2=0 THEN 'UNKNOWN' ELSE '  ' END, 'No, it is not.', 2, n_chars FROM dd WHERE doc_id%5=0),
ok AS (SELECT 'is_english' AS query_name, try_cast(did AS BIGINT) AS doc_id, CASE WHEN prediction='UNKNOWN' THEN 'No' ELSE prediction END AS prediction, raw, source_no, line_no FROM raw_rows WHERE trim(prediction)<>'' AND try_cast(did AS BIGINT) IS NOT NULL),
cache AS (SELECT query_name, doc_id, prediction, raw FROM (SELECT *, row_number() OVER (PARTITION BY query_name, doc_id ORDER BY source_no DESC, line_no DESC) AS rn FROM ok) WHERE rn=1)"""
_SYS3 = "You judge whether a document satisfies a condition. Reply with True, False or Unsure only."
_SYS2 = "You judge whether a document satisfies a condition. Reply with Yes or No only."


_ZERO = {
    "word": "You judge whether a document satisfies a condition. Answer with exactly one word, Yes or No.",
    "reasoned": "You judge whether a document satisfies a condition. Reason briefly, then give Yes or No alone on the last line.",
    "json": 'You judge whether a document satisfies a condition. If in doubt, say so. Reply with {"match": true}, {"match": false} or {"match": "unsure"} only.',
}


def _ask(text: str) -> str:
    return f"'Condition: '||query_description||E'\\nDocument:\\n'||{text}||E'\\nAnswer:'"


_P = ", pr AS (SELECT doc_id, query_name, query_description, text AS t FROM points)"
_HISTORY = """, told AS (SELECT *, escalated AND large_all IS NOT NULL AND large_all<>'UNKNOWN' AS told FROM rec),
hist0 AS (SELECT *, coalesce(sum(told::INT) OVER q,0) AS n_query, coalesce(sum((told AND small_prediction=large_all)::INT) OVER q,0) AS agree_query, coalesce(sum(told::INT) OVER o,0) AS n_doc, coalesce(sum((told AND small_prediction=large_all)::INT) OVER o,0) AS agree_doc
  FROM told WINDOW q AS (PARTITION BY query_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hist AS (SELECT *, round(least(ln(1+n_query)/ln(101),1),6) AS query_seen, round((agree_query+1)/(n_query+2),6) AS query_rate, round(least(ln(1+n_doc)/ln(101),1),6) AS doc_seen, round((agree_doc+1)/(n_doc+2),6) AS doc_rate FROM hist0)"""
_N = "round(({x})*10000)::BIGINT"
_POINT = "concat_ws(',', " + ", ".join(_N.replace("{x}", x) for x in (
    "{y}", "p_no", "confidence", "margin", "entropy_2way", "lp_yes", "lp_no", "CASE small_prediction WHEN 'Yes' THEN 1.0 WHEN 'No' THEN 0.0 ELSE 0.5 END",
    "ln(1+length(text))", "length(query_description)", "{seen}", "{rate}", "{qseen}", "{qrate}",
)) + ")"
_DIG = "md5('{seed}|'||{cols})"
_LAD = """, lad AS (SELECT *, lp_yes-lp_no AS odds0, (lp_yes-lp_no)*2+CASE WHEN h%3=0 THEN 4.0::DOUBLE ELSE -1.0::DOUBLE END AS odds1, (large_all='Yes')::INT AS large, truth::INT AS t FROM small)"""
_BAND = """, s AS (SELECT query_name, t, large, {between} AS mid, {sent} AS sent, CASE WHEN {sent} THEN large ELSE {own} END AS p FROM lad),
c AS (SELECT query_name, count(*) FILTER (p=1 AND t=1) AS tp, count(*) FILTER (p=1 AND t=0) AS fp, count(*) FILTER (p=0 AND t=0) AS tn, count(*) FILTER (p=0 AND t=1) AS fn, 0::BIGINT AS parse_fail, count(*) AS n_valid, count(*) FILTER (mid) AS n_uncertain,
  round(avg(sent::INT),6) AS esc_rate, round(avg((p=large)::INT),6) AS acc_vs_large, round(sum(CASE WHEN sent THEN 100*5.2e-7+7.5e-7 ELSE 0 END),9) AS usd FROM s GROUP BY 1)
SELECT *, round((tp+tn)/(tp+fp+tn+fn),6) AS accuracy, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0)::DOUBLE,6) AS f1 FROM c"""
_HIST = """, w AS (SELECT *, coalesce(sum(escalated::INT) OVER ({p} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS n,
  coalesce(sum((escalated AND small_prediction=large_all)::INT) OVER ({p} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS a FROM rec)
SELECT pos, {k}, n AS n_{s}, a AS agree_{s}, round(least(ln(1+n)/ln(101),1.0),6) AS {s}_seen, round((a+1)/(n+2),6) AS {s}_rate FROM w"""
_GATE = """, g0 AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY pos) AS t, count(*) OVER (PARTITION BY query_name) AS n_q FROM rec),
g1 AS (SELECT *, escalated AND small_prediction<>'UNKNOWN' AND small_prediction<>large_all AND t<=n_q/(1+{rho}) AS wish FROM g0),
g2 AS (SELECT *, wish AND coalesce(sum(wish::INT) OVER (PARTITION BY query_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)<{cap} AS trigger FROM g1)"""
_TERMS = "regexp_extract_all(lower({t}),'[a-z]+')"
_COUNTS = """, seen AS (SELECT dr.experience_id, r.query_name, r.pos, (r.small_prediction=r.large_all) AS good, r.confidence FROM dr JOIN rec r USING (doc_id) WHERE r.escalated AND rank<8),
help AS (SELECT experience_id, count(*) FILTER (good) AS pos, count(*) FILTER (NOT good) AS neg FROM seen GROUP BY 1), help_query AS (SELECT experience_id, query_name, count(*) FILTER (good) AS pos, count(*) FILTER (NOT good) AS neg FROM seen GROUP BY 1,2)"""
_BM25 = f""", dtok AS (SELECT doc_id, {_TERMS.format(t='text')} AS ts FROM documents), nd AS (SELECT count(*) AS nd, avg(len(ts)) AS al FROM dtok),
dterm AS (SELECT DISTINCT doc_id, unnest(ts) AS term FROM dtok), idf AS (SELECT term, ln((any_value(nd)-count(*)+0.5)/(count(*)+0.5)+1) AS idf, any_value(al) AS al FROM dterm CROSS JOIN nd GROUP BY term),
lsrc AS (SELECT l.*, d.text AS excerpt FROM les l LEFT JOIN documents d ON d.doc_id=l.source_doc_id),
ltok AS (SELECT experience_id, 't' AS kind, {_TERMS.format(t='experience_text')} AS ts FROM lsrc UNION ALL SELECT experience_id, 's', {_TERMS.format(t='excerpt')} FROM lsrc WHERE excerpt IS NOT NULL),
ltf AS (SELECT experience_id, kind, term, count(*) AS tf, any_value(l) AS l FROM (SELECT experience_id, kind, len(ts) AS l, unnest(ts) AS term FROM ltok) GROUP BY 1,2,3),
lw AS (SELECT experience_id, kind, term, idf*(tf*2.5/(tf+1.5*(0.25+0.75*l/al))) AS w FROM ltf JOIN idf USING (term)),
bm AS (SELECT doc_id, experience_id, kind, least(sum(w)/20,1.0) AS bm25 FROM dterm JOIN lw USING (term) GROUP BY 1,2,3),
bm_text AS (SELECT * FROM bm WHERE kind='t'), bm_source AS (SELECT * FROM bm WHERE kind='s')"""
_NAMES = ("cos_query_source", "cos_doc_source", "same_query", "rate", "rate_query", "seen", "cos_query_text", "cos_doc_text", "bm25_source", "stream_pos", "seen_query", "query_new", "rate_x_source", "bm25_text", "same_doc", "doc_seen", "doc_rate", "query_seen", "query_rate")
_CLIP = "least(greatest(coalesce(list_dot_product({a},{b}),0),0),1)"
_PHI = _HISTORY + _COUNTS + _BM25 + f""", qv AS (SELECT q.query_name, e.embedding::DOUBLE[] AS qvec FROM q JOIN embeddings e ON e.vec_id=q.qid), tot AS (SELECT count(*) AS total FROM points),
spos AS (SELECT pos, row_number() OVER (ORDER BY pos) AS t FROM points),
raw AS (SELECT h.*, dr.experience_id, dr.source_query, dr.source_doc_id, dr.rank, {_CLIP.format(a='qv.qvec', b='sv.qvec')} AS cos_query_source, {_CLIP.format(a='dv.vec', b='ev.vec')} AS cos_doc_source,
  {_CLIP.format(a='qv.qvec', b='les.vec')} AS cos_query_text, {_CLIP.format(a='dv.vec', b='les.vec')} AS cos_doc_text, coalesce(bs.bm25,0) AS bm25_source, coalesce(bt.bm25,0) AS bm25_text, t/total AS stream_pos,
  coalesce(c.pos,0) AS cp, coalesce(c.neg,0) AS cn, coalesce(k.pos,0) AS kp, coalesce(k.neg,0) AS kn
  FROM hist h JOIN dr ON dr.doc_id=h.doc_id AND dr.rank<8 JOIN les ON les.experience_id=dr.experience_id JOIN dv ON dv.doc_id=h.doc_id LEFT JOIN dv ev ON ev.doc_id=dr.source_doc_id JOIN qv ON qv.query_name=h.query_name JOIN qv sv ON sv.query_name=dr.source_query
  LEFT JOIN bm_text bt ON bt.doc_id=h.doc_id AND bt.experience_id=dr.experience_id LEFT JOIN bm_source bs ON bs.doc_id=h.doc_id AND bs.experience_id=dr.experience_id JOIN spos ON spos.pos=h.pos CROSS JOIN tot
  LEFT JOIN help c ON c.experience_id=dr.experience_id LEFT JOIN help_query k ON k.experience_id=dr.experience_id AND k.query_name=h.query_name),
phi AS (SELECT raw.* EXCLUDE (doc_seen, doc_rate, query_seen, query_rate), (query_name=source_query)::INT::DOUBLE AS same_query, (cp+1)/(cp+cn+2) AS rate, (kp+1)/(kp+kn+2) AS rate_query, least(ln(1+cp+cn)/ln(101),1) AS seen, least(ln(1+kp+kn)/ln(101),1) AS seen_query, (kp+kn<3)::INT::DOUBLE AS query_new,
  (cp+1)/(cp+cn+2)*cos_doc_source AS rate_x_source, (source_doc_id=doc_id)::INT::DOUBLE AS same_doc, least(ln(1+n_doc)/ln(101),1) AS doc_seen, (agree_doc+1)/(n_doc+2) AS doc_rate, least(ln(1+n_query)/ln(101),1) AS query_seen, (agree_query+1)/(n_query+2) AS query_rate FROM raw)"""
#: The pattern of weights that queries with a given head use.
_HEAD = [round((i % 5 - 2) / 4, 2) for i in range(19)]
_UNDER = f""", eta AS (SELECT *, {'+'.join(f'({w})*{c}' for w, c in zip(_HEAD, _NAMES))} AS eta, round({'+'.join(f'{c}*{c}' for c in _NAMES)},9) AS var FROM phi),
under AS (SELECT *, round(1/(1+exp(-eta)),9) AS p, row_number() OVER (PARTITION BY query_name, doc_id ORDER BY round(1/(1+exp(-eta)),9) DESC, experience_id)-1 AS rank_p FROM eta)"""
_PQ = ", pq AS (SELECT p.pos, p.doc_id, p.query_name, dr.experience_id, dr.source_query, dr.source_doc_id, dr.cos, dr.rank FROM points p JOIN dr USING (doc_id))"

SQL: dict[str, str] = {
    "cascade_confidence": f"{BASE} SELECT doc_id, query_name, small_prediction, round(confidence,6) AS confidence, escalated, large_prediction, prediction, ground_truth FROM rec",
    "metrics_overall": f"{BASE}, {_ratios('prediction', '', 'rec')} SELECT * FROM m",
    "metrics_per_query": _PER_QUERY,
    "online_single_epoch": _PER_QUERY,
    "all_small": f"{BASE}, {_ratios('small_prediction', 'query_name', 'small')} SELECT * FROM m",
    "all_big": f"{BASE}, {_ratios('large_all', 'query_name', 'small')} SELECT * FROM m",
    "points_ordered": f"""{BASE}, o AS (SELECT query_name, doc_id, row_number() OVER (PARTITION BY query_name ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY query_name ORDER BY length(text), doc_id) AS b,
      row_number() OVER (PARTITION BY query_name ORDER BY length(text) DESC, doc_id) AS c, row_number() OVER (PARTITION BY query_name ORDER BY md5('7|'||query_name||'|'||doc_id), doc_id) AS d FROM points)
      SELECT 'doc_id' AS ordering, query_name, doc_id, a AS order_no FROM o UNION ALL SELECT 'shortest', query_name, doc_id, b FROM o UNION ALL SELECT 'longest', query_name, doc_id, c FROM o UNION ALL SELECT 'shuffled', query_name, doc_id, d FROM o""",
    "limit_per_query": f"{BASE} SELECT query_name, doc_id, order_no FROM (SELECT query_name, doc_id, row_number() OVER (PARTITION BY query_name ORDER BY length(text) DESC, doc_id) AS order_no FROM points) WHERE order_no<=25",
    "point_scan": f"""{BASE}, pairs AS (SELECT doc_id, 'high_quality' AS query_name, CASE WHEN quality=1 THEN 'Yes' ELSE 'No' END AS ground_truth FROM labels UNION ALL SELECT doc_id, 'unknown_query', CASE WHEN toxic=1 THEN 'Yes' ELSE 'No' END FROM labels)
      SELECT p.query_name, coalesce(q.query_description,'') AS query_description, ground_truth, count(*) AS n, sum(length(text))::BIGINT AS chars FROM pairs p JOIN documents d USING (doc_id) LEFT JOIN q ON q.query_name=p.query_name GROUP BY 1,2,3""",
    "query_slice": f"""{BASE}, n AS (SELECT DISTINCT query_name FROM points) SELECT 'first' AS slice, query_name FROM n WHERE query_name IN ('is_english','toxic') UNION ALL SELECT 'prefix', query_name FROM n WHERE query_name LIKE 'h%'
      UNION ALL SELECT 'all', query_name FROM n UNION ALL SELECT 'list', query_name FROM n WHERE query_name IN ('toxic','long_doc','nothing')""",
    "matrix_melt": "SELECT doc_id AS document_id, 'high_quality' AS query_name, CASE WHEN quality=1 THEN 'Yes' ELSE 'No' END AS ground_truth FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic=1 THEN 'Yes' ELSE 'No' END FROM labels",
    "manifest": f"""{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_name, ground_truth ORDER BY md5('5|'||doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY query_name, ground_truth) AS n FROM points )
      SELECT doc_id, query_name, ground_truth, rn<=greatest(1, round_even(n*0.3::DOUBLE,0)) AS in_sample FROM r""",
    "layout": f"{BASE} SELECT query_name, doc_id, ground_truth AS gold, row_number() OVER (PARTITION BY query_name ORDER BY doc_id) AS order_no FROM points",
    "layout_meta": f"{BASE} SELECT query_name, count(*) AS n_rows, round(avg(length(text)/4+25),6) AS avg_tokens FROM points GROUP BY 1",
    "task_package": f"""{BASE} SELECT query_name, query_description AS question, md5(E'Answer the question about the document.\\n\\nQuestion: '||query_description||E'\\n\\n- True if the answer is Yes.\\n- False if it is No.') AS instruction_md5, 'A document.' AS prefix, 'Answer:' AS suffix, count(*) AS n_docs FROM points GROUP BY 1,2""",
    "small_features": f"""{BASE} SELECT query_name, doc_id AS document_id, round(least(greatest(lp_yes*9-lp_no,-30),30),6) AS log_odds, (h%5<>0)::INT AS gold, truth::INT AS human FROM small WHERE h%7<>0""",
    "small_features_lost": f"{BASE} SELECT count(*) FILTER (h%7=0) AS lost, count(*) AS n FROM small",
    "ladder_rows": f"{BASE} SELECT doc_id AS document_id, query_name, round(lp_yes-lp_no,6) AS odds0, CASE WHEN h%11<>0 THEN round(lp_yes*2,6) END AS odds1, h%3=0 AS in_sample, h%11<>0 AS finite FROM small",
    "accuracy_per_query": f"{BASE} SELECT query_name, round(avg((prediction=ground_truth)::INT),6) AS accuracy, count(*) AS n FROM rec GROUP BY 1",
    "record_projection": f"""{BASE} SELECT doc_id, query_name, prediction, CASE WHEN escalated THEN 'large' ELSE 'small' END AS routed_to, small_prediction, round(confidence,4) AS small_confidence, escalated, true AS router_bootstrap, small_in AS small_prompt_tokens, large_in AS large_prompt_tokens, verify_calls AS verify_small_calls,
      round(p_yes,6) AS small_p_yes, round(p_unsure,6) AS small_p_unsure FROM met""",
    "overhead_cost": f"""{BASE}, p(phase) AS (VALUES ('prepare'),('discover'),('apply')), c AS (SELECT CASE WHEN doc_id%4=0 THEN 'discover' ELSE 'apply' END AS phase, count(*) AS n_calls, round(sum(small_in*1e-8),9) AS usd FROM met GROUP BY 1)
      SELECT phase, coalesce(n_calls,0) AS n_calls, coalesce(usd,0.0::DOUBLE) AS usd FROM p LEFT JOIN c USING (phase)""",
    "parse_match": _edge(MATCH) + r"""SELECT doc_id, CASE WHEN raw LIKE '%{"match": true}%' THEN 'Yes' WHEN raw LIKE '%"Unsure"%' THEN 'unsure' WHEN raw LIKE '%{"match": false}%' OR raw LIKE '%other%' THEN 'No' WHEN contains(lower(raw),'unsure') THEN 'unsure' WHEN contains(lower(raw),'true') AND NOT contains(lower(raw),'false') THEN 'Yes' WHEN contains(lower(raw),'false') THEN 'No' ELSE 'PARSE_FAIL' END AS verdict FROM e""",
    "parse_flat_json": _edge(FLAT) + r"""SELECT doc_id, nullif(trim(regexp_extract(raw,'"condition": "([^"]*)"',1)),'') AS condition FROM e""",
    "yes_as_int": _edge(TRUTHY) + r"""SELECT doc_id, CASE raw WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS label, lower(trim(raw)) IN ('yes','1','true') AS truthy FROM e""",
    "collector_scan": f"{BASE} SELECT doc_id, query_name, round(lp_yes,6) AS yes, round(lp_no,6) AS no, NULL::DOUBLE AS unsure FROM small",
    "legacy_confidence": f"""{BASE}, f AS (SELECT doc_id, query_name, h%7<>0 AS k, lp_yes, exp(lp_yes)/(exp(lp_yes)+exp(lp_no)) AS y FROM small)
      SELECT doc_id, query_name, CASE WHEN NOT k THEN 'No' WHEN round(y,12)>=0.5 THEN 'Yes' ELSE 'No' END AS prediction, CASE WHEN k THEN round(greatest(y,1-y),6) ELSE 1.0 END AS confidence, 'No.' AS raw, CASE WHEN k THEN round(lp_yes,6) ELSE -10.0 END AS logprob_yes, k AS logprobs_available FROM f""",
    "point_features": f"""{BASE}{_HISTORY}, f AS (SELECT *, CASE WHEN h%23<>0 THEN p_yes ELSE 0.5 END AS y FROM hist)
      SELECT doc_id, query_name, {_POINT.format(y='y', seen='doc_seen', rate='doc_rate', qseen='query_seen', qrate='query_rate')} AS features FROM f""",
    "rollout_vector": f"""{BASE} SELECT doc_id, query_name, {_POINT.format(y='p_yes', seen='0', rate='0.5', qseen='0', qrate='0.5')}||repeat(',0',20) AS features FROM small""",
    "prompt_zero_shot": f"""{BASE}{_P} SELECT doc_id, query_name, {', '.join(f"md5('system: {text}'||E'\n\nuser: '||{_ask('t')}) AS {name}_md5" for name, text in _ZERO.items())} FROM pr""",
    "parse_yes_no": _edge(YES_NO) + r""", w AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(line,'[,.]',' ','g'),'\s+'), lambda x: x IN ('yes','no')) AS ws FROM l)
      SELECT doc_id, CASE WHEN line LIKE 'yes%' THEN 'Yes' WHEN line LIKE 'no%' THEN 'No' WHEN len(ws)>0 THEN CASE WHEN ws[1]='yes' THEN 'Yes' ELSE 'No' END ELSE 'UNKNOWN' END AS verdict FROM w""",
    "parse_3way": _edge(THREE) + r""", w AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(line,'[,.]',' ','g'),'\s+'), lambda x: x IN ('true','false','unsure')) AS ws FROM l),
      v AS (SELECT *, CASE WHEN line LIKE 'true%' THEN 'true' WHEN line LIKE 'false%' THEN 'false' WHEN line LIKE 'unsure%' THEN 'unsure' ELSE ws[1] END AS x FROM w)
      SELECT doc_id, CASE x WHEN 'true' THEN 'Yes' WHEN 'false' THEN 'No' WHEN 'unsure' THEN 'Unsure' ELSE 'UNKNOWN' END AS verdict FROM v""",
    "parse_zero_shot": _edge(ZERO_SHOT) + r""", w AS (SELECT *, coalesce(list_filter(list_transform(string_split(raw,E'\n'), lambda x: trim(x)), lambda x: x<>'')[-1],'') AS z FROM l),
      v AS (SELECT *, lower(regexp_replace(z,'\.$','')) AS p, regexp_extract(raw,'\b(Yes|No)\b',1) AS m FROM w)
      SELECT doc_id, CASE WHEN p='yes' THEN 'Yes' WHEN p='no' THEN 'No' WHEN lower(z) LIKE 'yes%' THEN 'Yes' WHEN lower(z) LIKE 'no%' THEN 'No' WHEN m<>'' THEN m ELSE 'PARSE_FAIL' END AS verdict FROM v""",
    "parse_predicate": _edge(YES_NO) + r"""SELECT doc_id, CASE lower(regexp_extract(raw,'(?i)^\s*(yes|no)\b',1)) WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' END AS verdict FROM e""",
    "parse_json": _edge(JSON) + r""", o AS (SELECT doc_id, regexp_extract(raw,'(?s)(\{.*\})',1) AS j FROM e) SELECT doc_id, CASE WHEN j<>'' THEN nullif(trim(json_extract_string(j,'$.lesson')),'') END AS lesson FROM o""",
    "scan_logprobs": f"{BASE} SELECT doc_id, query_name, round(lp_yes,6) AS yes, round(lp_no,6) AS no, round(lp_unsure,6) AS unsure FROM small",
    "features_2way": f"""{BASE}, f AS (SELECT doc_id, query_name, h%7<>0 AS k, exp(lp_yes)/(exp(lp_yes)+exp(lp_no)) AS y FROM small)
      SELECT doc_id, query_name, CASE WHEN NOT k THEN 'UNKNOWN' WHEN round(y,12)>=0.5 THEN 'Yes' ELSE 'No' END AS prediction, CASE WHEN k THEN round(greatest(y,1-y),6) ELSE 1.0 END AS confidence, CASE WHEN k THEN round(y,6) ELSE 0.5 END AS p_yes,
      CASE WHEN k THEN round(1-y,6) ELSE 0.5 END AS p_no, CASE WHEN k THEN round(abs(2*y-1),6) ELSE 0.0 END AS margin, round(CASE WHEN k THEN -(y*ln(y)+(1-y)*ln(1-y)) ELSE ln(2) END,6) AS entropy FROM f""",
    "features_3way": f"{BASE} SELECT doc_id, query_name, small_prediction, round(confidence,6) AS confidence, round(p_yes,6) AS p_yes, round(p_no,6) AS p_no, round(p_unsure,6) AS p_unsure, round(margin,6) AS margin, round(entropy_2way,6) AS entropy_2way, round(entropy_3way,6) AS entropy_3way FROM small",
    "features_collector": f"""{BASE}, f AS (SELECT doc_id, query_name, h%4 AS v, CASE WHEN h%3<>0 THEN exp(lp_yes) ELSE 0 END AS a, CASE WHEN h%2<>0 THEN exp(lp_no) ELSE 0 END AS b, CASE WHEN h%5<>0 THEN exp(lp_unsure) ELSE 0 END AS c FROM small),
      p AS (SELECT doc_id, query_name, v, CASE WHEN a+b+c=0 THEN 1/3.0::DOUBLE ELSE a/(a+b+c) END AS x, CASE WHEN a+b+c=0 THEN 1/3.0::DOUBLE ELSE b/(a+b+c) END AS y, CASE WHEN a+b+c=0 THEN 1/3.0::DOUBLE ELSE c/(a+b+c) END AS z FROM f)
      SELECT doc_id, query_name, round(x,6) AS p_true, round(y,6) AS p_false, round(z,6) AS p_unsure, round(CASE v WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN z ELSE greatest(x,y,z) END,6) AS confidence,
      round((-(CASE WHEN x>1e-10 THEN x*ln(x) ELSE 0 END)-(CASE WHEN y>1e-10 THEN y*ln(y) ELSE 0 END)-(CASE WHEN z>1e-10 THEN z*ln(z) ELSE 0 END))/ln(2),6) AS entropy FROM p""",
    "s_entropy": f"""{BASE}, f AS (SELECT doc_id, query_name, h, greatest(p_yes,1e-9)/(greatest(p_yes,1e-9)+greatest(p_no,1e-9)) AS y FROM small) SELECT doc_id, query_name, round(CASE WHEN h%11=0 THEN ln(2) ELSE -(y*ln(y)+(1-y)*ln(1-y)) END,6) AS s_entropy FROM f""",
    "z_label": f"{BASE} SELECT doc_id, query_name, CASE WHEN h%13=0 THEN NULL WHEN small_prediction IN ('UNKNOWN','Unsure') THEN 0 ELSE (small_prediction=large_all)::INT END AS z FROM small",
    "clipped_sigmoid": f"{BASE} SELECT doc_id, query_name, round(least(greatest(1/(1+exp(-(lp_yes-lp_no)*5)),1e-6),1-1e-6),6) AS p FROM small",
    "synthetic_ids": f"""{BASE} SELECT doc_id, query_name, 'synthq_'||substr(sha1(query_name),1,12) AS synthq, 'md_'||substr(sha1(query_name||'|'||doc_id),1,16) AS md, 'dc_'||substr(sha1(query_name||'|'||doc_id||'|pair'),1,16) AS dc, 'online__'||query_name||'__doc_'||doc_id AS experience_id FROM points""",
    "prompt_small": f"""{BASE}{_P} SELECT doc_id, query_name, md5('system: '||CASE WHEN doc_id%2=0 THEN '{_SYS3}'||E'\\nLessons from earlier cases:\\n1. Look at the title.\\n2. Ignore quotes.' ELSE '{_SYS3}' END||E'\\n\\nuser: '||{_ask("'a first text'")}||E'\\n\\nassistant: True\\n\\nuser: '||{_ask("'a second text'")}||E'\\n\\nassistant: False\\n\\nuser: '||{_ask('t')}) AS prompt_md5, 6::BIGINT AS n_messages FROM pr""",
    "prompt_two_way": f"""{BASE}{_P} SELECT doc_id, query_name, md5('system: {_SYS2}'||E'\\n\\nuser: '||{_ask("'a first text'")}||E'\\n\\nassistant: Yes\\n\\nuser: '||{_ask('t')}) AS prompt_md5 FROM pr""",
    "prompt_verify": f"""{BASE}{_P} SELECT doc_id, query_name, md5(E'demo one\\n---\\ndemo two\\n---\\nDocument: '||right(t,2000)||E'\\nCondition: '||query_description||E'\\nProposed: Yes\\nVerdict:') AS prompt_md5 FROM pr""",
    "prompt_lesson": f"""{BASE}{_P} SELECT doc_id, query_name, md5({_ask('t')}||E' No\\nIn two sentences, say which passages led you there.') AS explain_md5,
      md5(E'A helper answered No where Yes is right.\\nCondition: '||query_description||E'\\nDocument:\\n'||t||E'\\nIts reason: because\\nReply with JSON {{"lesson": ..., "when": ...}}.') AS lesson_md5 FROM pr""",
    "prompt_predicate": f"""{BASE}{_P} SELECT doc_id, query_name, md5(E'Does the document meet the condition? Start with Yes or No.\\nCondition: '||query_description||E'\\nDocument:\\n'||t) AS confirm_md5, md5(E'Write a condition that document A meets and document B does not.\\nA:\\n'||t||E'\\nB:\\n'||reverse(t)||E'\\nReply with JSON {{"condition": ...}}.') AS pair_md5,
      md5('Read {{'||replace(replace(t,'{{','{{{{'),'}}','}}}}')||'}}.') AS task_md5 FROM pr""",
    "cache_last_wins": f"{BASE}{_CACHE} SELECT * FROM cache",
    "cache_probe": f"{BASE}{_CACHE} SELECT p.query_name, p.doc_id, c.prediction AS cached_prediction, c.doc_id IS NOT NULL AS hit FROM points p LEFT JOIN cache c ON c.query_name=p.query_name AND c.doc_id=p.doc_id",
    "cache_misses": f"{BASE}{_CACHE} SELECT query_name, doc_id FROM points p WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.query_name=p.query_name AND c.doc_id=p.doc_id)",
    "cache_stats": f"""{BASE}{_CACHE}, u AS (SELECT count(c.doc_id) AS hits, count(*)-count(c.doc_id) AS misses FROM points p LEFT JOIN cache c ON c.query_name=p.query_name AND c.doc_id=p.doc_id)
      SELECT (SELECT count(*) FROM cache) AS n_entries, hits, misses, 0::BIGINT AS stores, round(hits/greatest(hits+misses,1),6) AS hit_rate FROM u""",
    "cascade_cached": f"""{BASE}{_CACHE}, r AS (SELECT d.*, c.doc_id IS NOT NULL AND escalated AS fc, CASE WHEN escalated THEN coalesce(c.prediction, large_all) ELSE small_prediction END AS fin FROM dec d LEFT JOIN cache c ON c.query_name=d.query_name AND c.doc_id=d.doc_id)
      SELECT query_name, count(*) FILTER (fc) AS from_cache, count(*) FILTER (escalated AND NOT fc) AS live, count(*) FILTER (fin=ground_truth) AS correct FROM r GROUP BY 1""",
    "token_summary": f"{BASE} SELECT (count(small_prediction)+sum(verify_calls))::BIGINT AS n_small_calls, count(*) FILTER (escalated) AS n_large_calls, sum(small_in+verify_in)::BIGINT AS small_in, sum(small_out+verify_out)::BIGINT AS small_out, sum(large_in)::BIGINT AS large_in, sum(large_out)::BIGINT AS large_out FROM met",
    "cost_usd": f"{BASE} SELECT query_name, round(sum(small_in*1e-8+small_out*5e-8+CASE WHEN escalated THEN large_in*5.2e-7+7.5e-7 ELSE 0 END),9) AS cost_usd, 0.0::DOUBLE AS direct_large_usd FROM met GROUP BY 1",
    "cost_abort": f"""{BASE}, c AS (SELECT *, small_in*1e-8+small_out*5e-8+CASE WHEN escalated THEN large_in*5.2e-7+7.5e-7 ELSE 0 END AS c FROM met), w AS (SELECT *, sum(c) OVER (ORDER BY pos) AS cum FROM c)
      SELECT pos, doc_id, query_name, round(cum,9) AS spent FROM w WHERE cum-c<=0.02""",
    "timing_summary": f"""{BASE}, t AS (SELECT 't_small' AS stage, (h%50)/100.0::DOUBLE AS t FROM rec UNION ALL SELECT 't_large', (h%30)/10.0::DOUBLE FROM rec WHERE escalated UNION ALL SELECT 't_retrieve', (doc_id%10)/1000.0::DOUBLE FROM rec)
      SELECT stage, round(avg(t),4) AS avg_s, count(*) AS n, round(sum(t),6) AS total_s, max(t) AS max_s FROM t GROUP BY 1""",
    "frontier_delta": f"""{_PER_QUERY.replace('SELECT m.*, n_points, n_escalated, escalation_rate FROM m JOIN x USING (query_name)', '')}, f(esc, acc) AS (VALUES (0.1::DOUBLE,0.7::DOUBLE),(0.4,0.8),(0.45,0.86),(0.9,0.95)),
      r AS (SELECT query_name AS name, escalation_rate AS esc, accuracy AS acc FROM m JOIN x USING (query_name)),
      b AS (SELECT r.*, (SELECT max(esc) FROM f WHERE f.esc<=r.esc) AS le, (SELECT min(esc) FROM f WHERE f.esc>=r.esc) AS he FROM r),
      v AS (SELECT b.*, l.acc AS la, u.acc AS ua FROM b LEFT JOIN f l ON l.esc=le LEFT JOIN f u ON u.esc=he),
      e AS (SELECT *, CASE WHEN le IS NULL THEN ua WHEN he IS NULL THEN la WHEN le=he THEN la ELSE la+(ua-la)*(esc-le)/(he-le) END AS x FROM v)
      SELECT name, esc, acc, round(x,6) AS frontier_acc, round(acc-x,6) AS delta FROM e""",
    "frontier_delta_f1": f"""{_PER_QUERY.replace('SELECT m.*, n_points, n_escalated, escalation_rate FROM m JOIN x USING (query_name)', '')}, f(esc, f1) AS (VALUES (0.1::DOUBLE,0.6::DOUBLE),(0.4,0.75),(0.45,0.8),(0.9,0.9)),
      r AS (SELECT query_name AS name, escalation_rate AS esc, m.f1 FROM m JOIN x USING (query_name)),
      b AS (SELECT r.*, (SELECT max(esc) FROM f WHERE f.esc<=r.esc) AS le, (SELECT min(esc) FROM f WHERE f.esc>=r.esc) AS he FROM r),
      v AS (SELECT b.*, l.f1 AS la, u.f1 AS ua FROM b LEFT JOIN f l ON l.esc=le LEFT JOIN f u ON u.esc=he),
      e AS (SELECT *, CASE WHEN le IS NULL THEN ua WHEN he IS NULL THEN la WHEN le=he THEN la ELSE la+(ua-la)*(esc-le)/(he-le) END AS x FROM v)
      SELECT name, esc, f1, round(x,6) AS frontier_f1, round(f1-x,6) AS delta FROM e""",
    "call_log_summary": f"""{BASE} SELECT CASE WHEN doc_id%4=0 THEN 'discover' ELSE 'apply' END AS phase, CASE WHEN escalated THEN 'large' ELSE 'small' END AS model, query_name AS kind, count(*) AS n_calls, sum(small_in)::BIGINT AS tokens_in, sum(small_out)::BIGINT AS tokens_out, round(sum(small_in*1e-8),9) AS usd FROM met GROUP BY 1,2,3""",
    "variant_summary": f"""{BASE}, v AS (SELECT *, CASE WHEN escalated THEN 'deep' ELSE 'plain' END AS variant, CASE WHEN doc_id%2=0 THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS alpha, unnest(CASE WHEN doc_id%5=0 THEN ['full','test'] ELSE ['full'] END) AS scope FROM rec)
      SELECT variant, alpha, scope, count(DISTINCT query_name) AS n_queries, count(*) AS n, round(avg((prediction=ground_truth)::INT),6) AS accuracy FROM v GROUP BY 1,2,3""",
    "topk_cosine": f"{BASE} SELECT doc_id, experience_id, round(cos,6) AS cos, rank FROM dr WHERE rank<8",
    "topk_same_query": f"""{BASE}, r AS (SELECT p.query_name, p.doc_id, dc.experience_id, dc.cos, row_number() OVER (PARTITION BY p.query_name, p.doc_id ORDER BY cos DESC, experience_id)-1 AS rank FROM points p JOIN dc ON dc.doc_id=p.doc_id AND dc.source_query=p.query_name)
      SELECT query_name, doc_id, experience_id, round(cos,6) AS cos, rank FROM r WHERE rank<3""",
    "helpfulness_rerank": f"""{BASE}, h AS (SELECT doc_id, experience_id, round(greatest((cos+1)/2,0)*CASE WHEN source_doc_id%7+source_doc_id%4>=4 THEN (source_doc_id%7+1)/(source_doc_id%7+source_doc_id%4+2) ELSE 0.5 END,9) AS score FROM dr WHERE rank<16),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, experience_id)-1 AS rank FROM h) SELECT doc_id, experience_id, round(score,6) AS score, rank FROM r WHERE rank<8""",
    "mmr_select": f"""{BASE}, sl AS (SELECT dr.*, les.vec FROM dr JOIN les USING (experience_id) WHERE rank<6), a AS (SELECT * FROM sl WHERE rank=0),
      b AS (SELECT sl.doc_id, sl.experience_id, row_number() OVER (PARTITION BY sl.doc_id ORDER BY round(0.7*sl.cos-0.3*list_dot_product(sl.vec,a.vec),10) DESC, sl.rank) AS r FROM sl JOIN a USING (doc_id) WHERE sl.rank>0)
      SELECT doc_id, experience_id, 0::BIGINT AS rank FROM a UNION ALL SELECT doc_id, experience_id, 1 FROM b WHERE r=1""",
    "fewshot_topk": f"""{BASE}, p AS (SELECT small.pos, small.doc_id, query_name, small_prediction, h, vec FROM small JOIN dv USING (doc_id)),
      j AS (SELECT a.query_name, a.doc_id, b.doc_id AS demo_doc, b.small_prediction AS label, list_dot_product(a.vec,b.vec) AS cos FROM p a JOIN p b ON a.query_name=b.query_name AND b.pos<a.pos AND b.doc_id<>a.doc_id WHERE b.h%2=0 AND b.small_prediction IN ('Yes','No')),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_name, doc_id ORDER BY cos DESC, demo_doc)-1 AS rank FROM j) SELECT query_name, doc_id, demo_doc, label, round(cos,6) AS cos, rank FROM r WHERE rank<2""",
    "bm25_idf": f"WITH t AS (SELECT doc_id, unnest(list_distinct({_TERMS.format(t='text')})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln((any_value(n)-count(*)+0.5)/(count(*)+0.5)+1),6) AS idf FROM t CROSS JOIN n GROUP BY term",
    "bm25_score": f"{BASE}{_BM25} SELECT doc_id, experience_id, round(bm25,6) AS bm25 FROM bm_text",
    "phi_features": f"{BASE}{_PHI} SELECT query_name, doc_id, experience_id, {', '.join(f'round({c},6) AS {c}' for c in _NAMES)} FROM phi WHERE rank<4",
    "head_rerank": f"{BASE}{_PHI}{_UNDER} SELECT query_name, doc_id, experience_id, round(p,6) AS p, rank_p AS rank FROM under WHERE rank_p<4",
    "head_signals": f"""{BASE}{_PHI}{_UNDER} SELECT query_name, doc_id, round(avg(p),6) AS mean_p, round(max(p),6) AS max_p, round(min(p),6) AS min_p, round(stddev_pop(p),6) AS std_p, round(arg_min(p,rank_p)-arg_max(p,rank_p),6) AS gap_p,
      round(avg(var),6) AS mean_var, round(max(var),6) AS max_var, round(ln(101)/ln(1001),6) AS head_seen, round(avg(same_query),6) AS same_query_share FROM under WHERE rank_p<4 GROUP BY 1,2""",
    "bandit_rerank": f"""{BASE}{_PHI}{_UNDER}, s AS (SELECT query_name, doc_id, experience_id, round(eta+sqrt(var/2),9) AS score FROM under), r AS (SELECT *, row_number() OVER (PARTITION BY query_name, doc_id ORDER BY score DESC, experience_id)-1 AS rank FROM s)
      SELECT query_name, doc_id, experience_id, round(score,6) AS score, rank FROM r WHERE rank<4""",
    "bandit_sums": f"""{BASE}{_PHI}, v AS (SELECT [{', '.join(_NAMES)}] AS phi, (phi.small_prediction=phi.large_all)::INT::DOUBLE AS y FROM phi WHERE rank<4 AND escalated), i AS (SELECT i FROM range(19) r(i)), j AS (SELECT j FROM range(-1,19) r(j))
      SELECT i::INT AS i, j::INT AS j, round(sum(phi[i+1]*CASE WHEN j<0 THEN y ELSE phi[greatest(j,0)+1] END),3) AS value FROM v CROSS JOIN i CROSS JOIN j GROUP BY 1,2""",
    "router_vector": f"""{BASE}{_PHI}{_UNDER}, m AS (SELECT query_name, doc_id, concat_ws(',', {', '.join(f'round(avg({c})*10000)::BIGINT' for c in _NAMES)}, round(avg(p)*10000)::BIGINT) AS set_part FROM under WHERE rank_p<4 AND doc_id%3<>0 GROUP BY 1,2)
      SELECT p.query_name, p.doc_id, 34::BIGINT AS width, coalesce(set_part, '0'||repeat(',0',19)) AS set_part FROM points p LEFT JOIN m ON m.query_name=p.query_name AND m.doc_id=p.doc_id""",
    "router_signals": f"""{BASE}{_PQ}{_COUNTS}, own AS (SELECT source_query AS query_name, count(*) AS own FROM les GROUP BY 1),
      j AS (SELECT pq.*, coalesce(c.pos,0) AS cp, coalesce(c.neg,0) AS cn, coalesce(k.pos,0) AS kp, coalesce(k.neg,0) AS kn, coalesce(own,0) AS own FROM pq LEFT JOIN help c ON c.experience_id=pq.experience_id LEFT JOIN help_query k ON k.experience_id=pq.experience_id AND k.query_name=pq.query_name LEFT JOIN own ON own.query_name=pq.query_name WHERE rank<8)
      SELECT query_name, doc_id, round(max(cos),6) AS max_score, round(avg(cos),6) AS mean_score, round(stddev_pop(cos),6) AS score_std, round(coalesce(max(cos) FILTER (rank=0)-avg(cos) FILTER (rank>0),0),6) AS gap, round(avg((source_query=query_name)::INT),6) AS same_query_share,
      round(avg((cp+1)/(cp+cn+2)),6) AS mean_help, round(avg((kp+1)/(kp+kn+2)),6) AS mean_help_query, round(least(avg(ln(1+cp+cn)/ln(101)),1),6) AS mean_seen, round(least(max(own)/16,1),6) AS pool_share, round(least(avg(ln(1+kp+kn)/ln(101)),1),6) AS mean_seen_query FROM j GROUP BY 1,2""",
    "query_history": BASE + _HIST.format(p="PARTITION BY query_name", k="query_name", s="query"),
    "doc_history": BASE + _HIST.format(p="PARTITION BY doc_id", k="doc_id", s="doc"),
    "position_gate": BASE + _GATE.format(rho="1.5::DOUBLE", cap=1 << 30) + " SELECT pos, query_name, t, n_q, coalesce(trigger, false) AS trigger FROM g2",
    "generation_cap": BASE + _GATE.format(rho="0.5::DOUBLE", cap=5) + " SELECT pos, query_name, doc_id FROM g2 WHERE trigger",
    "generation_cap_released": BASE + _GATE.format(rho="0.5::DOUBLE", cap=1 << 30) + """, g3 AS (SELECT *, coalesce(sum((doc_id%3<>0)::INT) OVER (PARTITION BY query_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS made FROM g2 WHERE wish) SELECT pos, query_name, doc_id FROM g3 WHERE made<5""",
    "helpfulness_prefix": f"""{BASE}, e AS (SELECT r.pos, dr.experience_id, r.small_prediction=r.large_all AS good FROM dr JOIN rec r USING (doc_id) WHERE r.escalated AND rank<4)
      SELECT pos, experience_id, coalesce(sum(good::INT) OVER w,0)::BIGINT AS pos_all, coalesce(sum((NOT good)::INT) OVER w,0)::BIGINT AS neg_all FROM e WINDOW w AS (PARTITION BY experience_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "helpfulness_prefix_query": f"""{BASE}, e AS (SELECT r.pos, r.query_name, dr.experience_id, r.confidence, r.small_prediction=r.large_all AS good FROM dr JOIN rec r USING (doc_id) WHERE r.escalated AND rank<4)
      SELECT pos, experience_id, round(coalesce(sum(CASE WHEN good THEN confidence ELSE 0 END) OVER w,0),6) AS pos_query, round(coalesce(sum(CASE WHEN good THEN 0 ELSE confidence END) OVER w,0),6) AS neg_query FROM e WINDOW w AS (PARTITION BY experience_id, query_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "helpfulness_weighted": f"{BASE}{_COUNTS} SELECT experience_id, round(coalesce(sum(confidence) FILTER (good),0),6) AS pos, round(coalesce(sum(confidence) FILTER (NOT good),0),6) AS neg FROM seen GROUP BY 1",
    "helpfulness_rollup": f"{BASE}{_COUNTS} SELECT count(*) AS lessons_observed, sum(pos)::BIGINT AS total_pos, sum(neg)::BIGINT AS total_neg FROM help",
    "online_counters": f"{BASE} SELECT experience_id, count(*) FILTER (small_prediction=large_all) AS pos, count(*) FILTER (small_prediction<>large_all) AS neg FROM dr JOIN rec USING (doc_id) WHERE escalated AND rank<4 GROUP BY 1",
    "online_histories": f"{BASE} SELECT query_name, count(*) AS n_query, count(*) FILTER (small_prediction=large_all) AS agree_query FROM rec WHERE escalated GROUP BY 1",
    "online_frozen": f"{BASE} SELECT doc_id, query_name, least((SELECT count(*) FROM les),4)::BIGINT AS n_lessons, escalated, prediction FROM rec",
    "online_cost_abort": f"""{BASE}, c AS (SELECT *, 1e-6+CASE WHEN escalated THEN 5e-5 ELSE 0 END AS c FROM rec), w AS (SELECT *, sum(c) OVER (ORDER BY pos) AS cum FROM c) SELECT pos, doc_id, query_name FROM w WHERE cum-c<=0.02""",
    "trigger_summary": BASE + _GATE.format(rho="0.5::DOUBLE", cap=40) + " SELECT count(*) AS n_triggers, count(*) FILTER (doc_id%2=0) AS n_accepted, count(*) FILTER (doc_id%2<>0) AS n_rejected FROM g2 WHERE trigger",
    "generation_log": BASE + _GATE.format(rho="0.5::DOUBLE", cap=50) + """ SELECT query_name, count(*) AS attempted, count(*) FILTER (doc_id%5<>0 AND doc_id%7<>0) AS succeeded, count(*) FILTER (doc_id%5<>0 AND doc_id%7=0) AS parse_failures, count(*) FILTER (doc_id%5=0) AS llm_errors,
      10*count(*) AS explain_in, 2*count(*) AS explain_out, 20*count(*) AS lesson_in, 4*count(*) AS lesson_out, round(avg((doc_id%8)/8.0::DOUBLE),4) AS avg_explain_s, 0.5::DOUBLE AS avg_lesson_s FROM g2 WHERE trigger GROUP BY 1""",
    "loo_gated": f"""{BASE}, r AS (SELECT * FROM dr WHERE rank<3 AND doc_id%4=0) SELECT a.doc_id, 'aug_loo' AS role, a.rank AS left_out, string_agg(b.experience_id, ',' ORDER BY b.rank) AS kept FROM r a JOIN r b ON a.doc_id=b.doc_id AND a.rank<>b.rank GROUP BY a.doc_id, a.rank
      UNION ALL SELECT DISTINCT doc_id, 'aug_noexp', -1, '' FROM r""",
    "stream_position": f"{BASE} SELECT pos, round(least(row_number() OVER (ORDER BY pos)/count(*) OVER (), 1.0),6) AS stream_pos FROM points",
    "helpfulness_counters": f"{BASE} SELECT experience_id, query_name, count(*) FILTER (small_prediction=large_all) AS pos, count(*) FILTER (small_prediction<>large_all) AS neg FROM dr JOIN rec USING (doc_id) WHERE escalated AND rank<8 GROUP BY 1,2",
    "usage_recordings": f"""{BASE}{_PQ}, k AS (SELECT experience_id, query_name, count(*) AS n, sum(rank) AS r FROM pq WHERE rank<4 GROUP BY 1,2)
      SELECT experience_id, sum(n)::BIGINT AS times_retrieved, sum(r)::BIGINT AS rank_sum, round(sum(r)/sum(n),6) AS avg_rank, count(*) AS n_queries, string_agg(query_name||':'||n, ',' ORDER BY query_name) AS by_query FROM k GROUP BY 1""",
    "trigger_usage": BASE + _GATE.format(rho="0.5::DOUBLE", cap=40) + """, u AS (SELECT experience_id, count(*) AS n FROM dr WHERE rank<8 GROUP BY 1), t AS (SELECT query_name, doc_id, CASE WHEN doc_id%2=0 THEN printf('exp_%03d', (doc_id%40)::BIGINT) END AS experience_id FROM g2 WHERE trigger)
      SELECT experience_id, query_name, doc_id, coalesce(n,0) AS times_retrieved FROM t LEFT JOIN u USING (experience_id)""",
    "loo_variants": f"{BASE}, r AS (SELECT * FROM dr WHERE rank<3) SELECT a.doc_id, a.rank AS left_out, a.experience_id AS without, string_agg(b.experience_id, ',' ORDER BY b.rank) AS kept FROM r a JOIN r b ON a.doc_id=b.doc_id AND a.rank<>b.rank GROUP BY 1,2,3",
    "stratified_sample": f"""{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_name, ground_truth ORDER BY md5('3|'||doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY query_name, ground_truth) AS n FROM points)
      SELECT query_name, ground_truth, doc_id FROM r WHERE rn<=greatest(1, round_even(n*0.15::DOUBLE,0))""",
    "two_phase_split": f"""{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY md5('11|'||doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY query_name) AS n FROM points) SELECT query_name, doc_id, CASE WHEN rn<=round_even(n*0.6::DOUBLE,0) THEN 1 ELSE 2 END AS phase FROM r""",
    "seed_until_both": f"""{BASE}, r AS (SELECT *, row_number() OVER w AS order_no, min(truth::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, max(truth::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM points WINDOW w AS (PARTITION BY query_name ORDER BY md5('4|'||doc_id), doc_id))
      SELECT query_name, doc_id, order_no FROM r WHERE order_no<=3 OR NOT coalesce(lo=0 AND hi=1, false)""",
    "train_val_split": f"""{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY md5('9|'||doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY query_name) AS n FROM points) SELECT query_name, doc_id, rn<=CASE WHEN n<2 THEN 0 ELSE greatest(1, round_even(n*0.15::DOUBLE,0)) END AS is_val FROM r""",
    "random_pairs": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3|'||doc_id), doc_id)-1 AS k FROM documents) SELECT (a.k//2)::BIGINT AS pair, a.doc_id, b.doc_id AS other_id FROM r a JOIN r b ON b.k=a.k+1 WHERE a.k%2=0 AND a.k<80""",
    "smoothed_histogram": f"""{BASE}, b AS (SELECT query_name, greatest(least(floor(p_yes*64),63),0)::INT AS bin, count(*) AS n FROM small GROUP BY 1,2) SELECT query_name, bin, round(avg(n) OVER (PARTITION BY query_name ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),6) AS smooth FROM b""",
    "candidates_with_docs": f"{BASE} SELECT doc_id, query_name AS predicate, length(text) AS chars FROM points WHERE pos%2=0",
    "detector_rows": f"""{BASE} SELECT query_name, doc_id, small_prediction, large_all AS oracle_label, CASE WHEN h%17<>0 THEN 0.5::DOUBLE END AS p_agree, escalated, CASE WHEN small_prediction IN ('Yes','No') THEN (small_prediction=large_all)::INT END AS z FROM dec""",
    "log_loss": f"""{BASE}, z AS (SELECT least(greatest(confidence,1e-9),1-1e-9) AS q, CASE WHEN small_prediction='Unsure' THEN 0 ELSE (small_prediction=large_all)::INT END AS z FROM small) SELECT round(avg(-(z*ln(q)+(1-z)*ln(1-q))),6) AS log_loss FROM z""",
    "served_confusion": f"""{BASE}, s AS (SELECT query_name, h%19=0 AS u, p_yes>=0.5 AS p, truth AS g FROM small), c AS (SELECT query_name, count(*) FILTER (NOT u AND p AND g) AS tp, count(*) FILTER (NOT u AND p AND NOT g) AS fp, count(*) FILTER (NOT u AND NOT p AND NOT g) AS tn, count(*) FILTER (NOT u AND NOT p AND g) AS fn, count(*) FILTER (u) AS parse_fail FROM s GROUP BY 1)
      SELECT *, round(coalesce((tp+tn)/nullif(tp+fp+tn+fn,0),0)::DOUBLE,6) AS accuracy, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0)::DOUBLE,6) AS f1 FROM c""",
    "band_outcome": f"{BASE}{_LAD}{_BAND.format(sent='(p_yes>=0.3 AND p_yes<0.7) OR doc_id%10=0', between='p_yes>=0.3 AND p_yes<0.7', own='(p_yes>=0.7)::INT')}",
    "degenerate_rows": f"{BASE}{_LAD}{_BAND.format(sent='true', between='true', own='0')}",
    "acq_distribution": f"""{BASE}, c AS (SELECT query_name, doc_id, greatest(confidence-0.6,0) AS s FROM small) SELECT query_name, doc_id, round(1000*(0.9*s/sum(s) OVER (PARTITION BY query_name)+0.1/count(*) OVER (PARTITION BY query_name)),6) AS q_milli FROM c""",
    "ips_weights": f"""{BASE}, c AS (SELECT query_name, doc_id, 1-confidence AS s FROM small), q1 AS (SELECT query_name, doc_id, 0.8*s/sum(s) OVER (PARTITION BY query_name)+0.2/count(*) OVER (PARTITION BY query_name) AS q FROM c)
      SELECT query_name, doc_id, round(least(greatest((1/q)/avg(1/q) OVER (PARTITION BY query_name),0.1),10),6) AS weight FROM q1""",
    "conf_cap": f"""{BASE}, c AS (SELECT query_name, doc_id, round(confidence,6) AS confidence FROM small), r AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY (confidence>=0.5)::INT, confidence, doc_id) AS rn, sum((confidence<0.5)::INT) OVER (PARTITION BY query_name) AS k FROM c)
      SELECT query_name, doc_id, confidence FROM r WHERE rn<=greatest(k,120)""",
    "surest_batch": f"{BASE}, r AS (SELECT query_name, doc_id, row_number() OVER (PARTITION BY query_name ORDER BY greatest(round(p_yes,6),1-round(p_yes,6)) DESC, doc_id) AS rank FROM small) SELECT * FROM r WHERE rank<=20",
    "automix_threshold": f"""{BASE}, v AS (SELECT *, len(list_filter(range(8), lambda i: (h+i*13)%5<3)) AS ok, len(list_filter(range(8), lambda i: (h+i*13)%5=3)) AS bad FROM small), f AS (SELECT *, round(coalesce(ok/nullif(ok+bad,0),0),6) AS verify_score FROM v)
      SELECT doc_id, query_name, verify_score, small_prediction NOT IN ('Yes','No') OR verify_score<=0.75 AS escalated FROM f""",
    "router_bootstrap": f"{BASE} SELECT doc_id, query_name, small_prediction IN ('UNKNOWN','Unsure') OR confidence<0.9 AS escalated FROM small",
    "router_veto": f"{BASE} SELECT doc_id, query_name, small_prediction IN ('UNKNOWN','Unsure') OR (CASE WHEN h%17=0 THEN confidence<0.9 ELSE (h%100)/100.0::DOUBLE<0.6::DOUBLE AND NOT confidence>=0.85 END) AS escalated FROM small",
    "detector_meta": f"{BASE} SELECT count(*) AS n, count(*) FILTER (small_prediction IN ('Yes','No')) AS n_definitive, count(*) FILTER (small_prediction='Unsure') AS n_unsure, count(*) FILTER (h%17=0) AS n_null_p FROM small",
    "scaledoc_histogram": f"{BASE} SELECT query_name, greatest(least(floor(p_yes*64),63),0)::INT AS bin, count(*) AS n, count(*) FILTER (truth) AS n_pos FROM small GROUP BY 1,2",
    "scaledoc_sweep": f"""{BASE}{_LAD}, st AS (SELECT i, i/32.0::DOUBLE AS v FROM range(33) r(i)), pr AS (SELECT a.v AS low, b.v AS high FROM st a JOIN st b ON b.i>=a.i),
      sw AS (SELECT query_name, low, high, sum(CASE WHEN p_yes<low THEN 1-t WHEN p_yes>=high THEN t ELSE (t=large)::INT END) AS rt, sum((p_yes>=low AND p_yes<high)::INT) AS sent, count(*) AS n FROM lad CROSS JOIN pr GROUP BY 1,2,3),
      b AS (SELECT i/10.0::DOUBLE AS budget FROM range(1,11) r(i)), rk AS (SELECT *, row_number() OVER (PARTITION BY query_name, budget ORDER BY rt DESC, sent, low, high) AS r FROM sw JOIN b ON sent<=budget*n)
      SELECT query_name, budget, low, high, round(rt/n,6) AS accuracy, round(sent/n,6) AS sent_share FROM rk WHERE r=1""",
    "best_threshold": f"""{BASE}{_LAD}, c AS (SELECT query_name, round(p_yes,4) AS cut, count(*) AS n, sum(t) AS pos FROM lad GROUP BY 1,2), tt AS (SELECT query_name, count(*) AS total, sum(t) AS ap FROM lad GROUP BY 1),
      u AS (SELECT query_name, cut, sum(n) OVER d AS k, sum(pos) OVER d AS tp FROM c WINDOW d AS (PARTITION BY query_name ORDER BY cut DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) UNION ALL SELECT query_name, NULL, 0, 0 FROM tt),
      w AS (SELECT u.*, total, total-(k-tp)-(ap-tp) AS rt, round(coalesce(2*tp/nullif(2*tp+(k-tp)+(ap-tp),0),0)::DOUBLE,9) AS f FROM u JOIN tt USING (query_name)),
      x AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY rt DESC, k) AS ra, row_number() OVER (PARTITION BY query_name ORDER BY f DESC, k) AS rf FROM w)
      SELECT a.query_name, a.cut, round(a.rt/a.total,6) AS accuracy, b.cut AS f1_cut, round(b.f,6) AS f1 FROM x a JOIN x b ON a.query_name=b.query_name AND a.ra=1 AND b.rf=1""",
    "stretto_simulate": f"""{BASE}{_LAD}, v AS (SELECT *, CASE WHEN odds0<-2 THEN 0 WHEN odds0>2.5 THEN 1 END AS a, CASE WHEN odds1<-1 THEN 0 WHEN odds1>3 THEN 1 END AS b FROM lad)
      SELECT doc_id, query_name, (CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 2 ELSE 3 END)::BIGINT AS rung, coalesce(a,b,large)::BIGINT AS verdict FROM v""",
    "rung_counts": f"""{BASE}{_LAD}, v AS (SELECT *, CASE WHEN odds0<-2 THEN 0 WHEN odds0>2.5 THEN 1 END AS a, CASE WHEN odds1<-1 THEN 0 WHEN odds1>3 THEN 1 END AS b FROM lad)
      SELECT query_name, (CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 ELSE 2 END)::BIGINT AS rung, count(*) AS n FROM v GROUP BY 1,2""",
    "uqe_served": f"{BASE} SELECT doc_id, query_name, CASE WHEN doc_id%4=0 THEN CASE WHEN h%19=0 THEN 'UNKNOWN' ELSE large_all END WHEN round(p_yes,6)>=0.5 THEN 'Yes' ELSE 'No' END AS served FROM small",
    "lightproxy_outcomes": f"""{BASE}, o AS (SELECT query_name, count(*) AS n, count(*) FILTER (doc_id%5=0) AS n_probe, avg(((round(p_yes,6)>=0.5)=(large_all='Yes'))::INT) FILTER (doc_id%5=0) AS a FROM small GROUP BY 1)
      SELECT query_name, n, n_probe, round(a,6) AS agreement, coalesce(a>=0.8,false) AS proxy_used, CASE WHEN coalesce(a>=0.8,false) THEN n_probe ELSE n END AS large_calls FROM o""",
    "taskcascade_replay": f"""{BASE}, v AS (SELECT doc_id, query_name, large_all, round(p_yes,6) AS a, round(1-p_no,6) AS b FROM small),
      f AS (SELECT *, CASE WHEN a>=0.5 THEN 'Yes' ELSE 'No' END AS pa, greatest(a,1-a)>=CASE WHEN a>=0.5 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS sa, CASE WHEN b>=0.5 THEN 'Yes' ELSE 'No' END AS pb, greatest(b,1-b)>=CASE WHEN b>=0.5 THEN 0.7::DOUBLE ELSE 0.75::DOUBLE END AS sb FROM v)
      SELECT doc_id, query_name, CASE WHEN sa THEN pa WHEN sb THEN pb ELSE large_all END AS prediction, CASE WHEN sa THEN 'a' WHEN sb THEN 'b' ELSE 'large' END AS stage, NOT sa AND NOT sb AS escalated, large_all AS large_prediction FROM f""",
    "cascade_against_gold": f"{BASE}, {_ratios('prediction', 'query_name', 'rec')}, y AS (SELECT query_name, round(avg((prediction=large_all)::INT),6) AS agree_large, round(avg(escalated::INT),6) AS esc_rate FROM rec GROUP BY 1) SELECT m.*, agree_large, esc_rate FROM m JOIN y USING (query_name)",
}
