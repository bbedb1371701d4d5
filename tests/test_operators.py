"""Operators against plain Python and closed forms."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwise.operators import baselines, learners, metrics, prefix, retrieval, routing, sampling
from siftwise.sources import cache, clients, config, experiences
from siftwise.sources import points as pts


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("UNKNOWN", "Yes"), ("Unsure", "No")], "prediction string, ground_truth string")
    r = metrics.binary(df, []).first()
    assert (r.n, r.parse_fail, r.n_other, r.accuracy, r.f1) == (0, 1, 1, 0.0, 0.0)
    one = metrics.binary(spark.createDataFrame([("Yes", "Yes")], "prediction string, ground_truth string"), []).first()
    assert (one.precision, one.recall, one.f1) == (1.0, 1.0, 1.0)


def test_frontier(spark):
    run = spark.createDataFrame([("below", 0.0, 0.5), ("above", 1.0, 0.5), ("mid", 0.3, 0.5), ("at", 0.2, 0.5)], "name string, esc double, acc double")
    line = spark.createDataFrame([(0.2, 0.6), (0.4, 0.8)], "esc double, acc double")
    got = {r.name: r.frontier_acc for r in metrics.frontier_delta(run, line).collect()}
    assert got == {"below": 0.6, "above": 0.8, "mid": 0.7, "at": 0.6}
    assert {r.frontier_acc for r in metrics.frontier_delta(run, line.limit(1)).collect()} == {None}


@pytest.mark.parametrize("width", [1, 3, 1 << 20])
def test_running_sums_do_not_depend_on_ranges(spark, width):
    rows = [(i * 2, "ab"[i % 2], i % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "pos long, k string, v long")
    got = {r.pos: r.s for r in prefix.running(df, ["k"], "pos", {"s": F.col("v")}, width).collect()}
    assert got == {p: sum(v for q, j, v in rows if j == k and q < p) for p, k, _ in rows}


def test_gate_and_cost(spark):
    rows = [(i, i, "q", True, "Yes", "No") for i in range(10)] + [(10, 10, "q", True, None, "No")]
    df = spark.createDataFrame(rows, "pos long, doc_id long, query_name string, escalated boolean, small_prediction string, large_prediction string")
    assert prefix.gate(df, 0.0, 3).where("trigger").count() == 3
    assert prefix.gate(df, 1e9, 3).where("trigger").count() == 0
    assert prefix.gate(df, 0.0, 0).where("trigger").count() == 0
    spent = lambda cap: prefix.until_cost(df.select("pos"), F.lit(1.0), cap).count()
    assert (spent(0.5), spent(3.0), spent(100.0)) == (1, 4, 11)


def test_routers(spark):
    df = spark.createDataFrame([("Yes", 0.8), ("Yes", 0.79), ("Unsure", 1.0), (None, 1.0)], "small_prediction string, confidence double")
    assert [r[0] for r in df.select(routing.router("confidence_threshold", threshold=0.8)).collect()] == [False, True, True, True]
    votes = spark.createDataFrame([(["Correct", "incorrect"],), (["hm"],), ([],)], "v array<string>")
    assert [r[0] for r in votes.select(routing.verify_score(F.col("v"))).collect()] == [0.5, 0.0, 0.0]
    with pytest.raises(KeyError, match="known"):
        routing.router("nothing")


def test_cache(spark):
    rows = [("q", "1", "Yes", "a", 1, 1), ("q", "1", "UNKNOWN", "no way", 2, 1), ("q", "2", " ", "x", 1, 2), ("q", "z", "Yes", "x", 1, 3), ("q", "3", "Yes", "x", 1, 1), ("q", "3", "No", "y", 1, 2)]
    df = spark.createDataFrame(rows, "query_name string, doc_id string, prediction string, raw string, source_no int, line_no int")
    assert {(r.doc_id, r.prediction) for r in cache.merge(df).collect()} == {(1, "No"), (3, "No")}


def test_cache_folder(spark, tmp_path):
    at = f"{tmp_path}/cache"
    one = spark.createDataFrame([("q", 1, "Yes", "a"), ("q", 2, "No", "b")], "query_name string, doc_id long, prediction string, raw string")
    cache.append(one, at)
    assert {(r.doc_id, r.prediction) for r in cache.merge(cache.read(spark, at)).collect()} == {(1, "Yes"), (2, "No")}


def test_experience_files(spark, tmp_path):
    at = f"{tmp_path}/pool"
    spark.createDataFrame([("e", "q", 1, "text")], "experience_id string, source_query string, source_doc_id long, experience_text string").write.json(at)
    r = experiences.read_experiences(spark, at).first()
    assert (r.source_doc_excerpt, r.applicability_signal, r.score, r.experience_text) == ("", "", 0.0, "text")


def test_points_from_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text('document_id,document_name,body\n1,a,"two\nlines, ""quoted"""\n2,b,x\n')
    (tmp_path / "p.csv").write_text("document_id,query_name,ground_truth\n1,q,Yes\n3,q,No\n2,r,No\n")
    (tmp_path / "q.csv").write_text("query_name,query_description\nq, trimmed \n")
    known = pts.Registry({"d": pts.Dataset(f"{tmp_path}/d.csv", f"{tmp_path}/p.csv", f"{tmp_path}/q.csv", "body")})
    got = sorted((r.document_id, r.text, r.query_description) for r in pts.points(*pts.load(spark, known["d"])).collect())
    assert got == [(1, 'two\nlines, "quoted"', "trimmed"), (2, "x", "")]
    with pytest.raises(KeyError, match="known"):
        known["other"]


def test_clients(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, prompt string")
    got = {r.doc_id: r.raw for r in clients.ask(df, lambda: clients.Replay({"a": "Yes"}, "No")).collect()}
    assert got == {1: "Yes", 2: "No"}

    class Broken:
        def answer(self, prompts):
            raise OSError("down")

    assert {r.error for r in clients.ask(df, Broken).collect()} == {"down"}
    done = df.where("doc_id = 1").withColumn("query_name", F.lit("q"))
    assert [r.doc_id for r in clients.collect_answers(df.withColumn("query_name", F.lit("q")), done, lambda: clients.Replay({})).collect()] == [2]
    tries = []
    with pytest.raises(OSError):
        clients.with_retries(lambda: tries.append(1) or (_ for _ in ()).throw(OSError("x")), wait=0)
    assert len(tries) == 3


def test_config(tmp_path):
    at = tmp_path / "c.json"
    at.write_text(json.dumps({"output": "o", "router": {"threshold": 0.5}}))
    c = config.load(str(at), ("router.k=3", "order=longest"))
    assert (c.router.threshold, c.router.k, c.order) == (0.5, 3, "longest")
    with pytest.raises(ValueError, match="unknown"):
        config.load(str(at), ("nothing=1",))
    with pytest.raises(ValueError, match="output"):
        config.load()
    with pytest.raises(ValueError, match="threshold"):
        config.Router(threshold=2)
    assert config.as_flags({"a_b": True, "c": [1, 2], "d": None, "e": False, "f": 3}) == ["--a-b", "--c", "1", "2", "--f", "3"]


def test_mmr(spark):
    e = np.eye(3)
    cos, vectors = np.array([0.9, 0.8, 0.5]), [e[0], e[0], e[1]]
    assert retrieval.diverse(cos, vectors, 2, 1.0) == [0, 1]
    assert retrieval.diverse(cos, vectors, 2, 0.5) == [0, 2]
    assert retrieval.diverse(cos, [None] * 3, 3, 0.5) == [0, 1, 2]
    rows = [(1, i, float(c), [float(x) for x in v]) for i, c, v in zip("abc", cos, vectors, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, experience_id string, cos double, exp_vec array<double>")
    assert [r.experience_id for r in retrieval.mmr(df, ["doc_id"], 2, 0.5).orderBy("rank").collect()] == ["a", "c"]


def test_bm25(spark):
    """Frequencies and the mean length are the documents', not the lessons'."""
    docs = spark.createDataFrame([(1, "apple pear"), (2, ""), (3, None), (4, "pear plum fig")], "doc_id long, text string")
    lessons = spark.createDataFrame([("e", "apple apple fig"), ("f", "cherry")], "experience_id string, experience_text string")
    got = {(r.doc_id, r.experience_id): r.bm25 for r in retrieval.bm25(docs, lessons).collect()}
    idf = lambda df: math.log((4 - df + 0.5) / (df + 0.5) + 1)
    add = 1.5 * (0.25 + 0.75 * 3 / (5 / 4))
    assert got == {(1, "e"): pytest.approx(idf(1) * 2 * 2.5 / (2 + add) / 20), (4, "e"): pytest.approx(idf(1) * 2.5 / (1 + add) / 20)}


def test_pools_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties
    pool = spark.createDataFrame([(f"e{i:02d}", "pq"[i % 2], v.tolist()) for i, v in enumerate(vectors)], "experience_id string, source_query string, vec array<double>")
    points = spark.createDataFrame([(i, "pq"[i % 2], rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(20)], "doc_id long, query_name string, vec array<double>")
    take = lambda same: sorted((r.doc_id, r["rank"], r.experience_id) for r in retrieval.top_k(points, pool, ["doc_id"], 5, same).collect())
    whole = [take(False), take(True)]
    for r in points.collect():
        order = sorted(range(60), key=lambda i: (-float(vectors[i] @ np.array(r.vec)), i))
        assert [x[2] for x in whole[0] if x[0] == r.doc_id] == [f"e{i:02d}" for i in order[:5]]
        assert [x[2] for x in whole[1] if x[0] == r.doc_id] == [f"e{i:02d}" for i in order if "pq"[i % 2] == r.query_name][:5]
    monkeypatch.setattr(retrieval, "SENT_POOL", 13)
    assert [take(False), take(True)] == whole


def test_demonstrations_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "pq"[i % 2], i // 2, rng.integers(-2, 3, 3).astype(float).tolist(), ("Yes", "No", "Unsure")[i % 3]) for i in range(50)]
    df = spark.createDataFrame(rows, "pos long, query_name string, doc_id long, vec array<double>, prediction string")
    expected = set()
    for pos, q, doc, v, _ in rows:
        past = [(-float(np.dot(v, w)), d) for p, k, d, w, said in rows if k == q and p < pos and d != doc and said != "Unsure"]
        expected |= {(pos, r, d) for r, (_, d) in enumerate(sorted(past)[:2])}
    for block in (4, 1000):
        got = {(r.pos, r["rank"], r.demo_doc) for r in retrieval.demonstrations(df, df, 2, block=block).collect()}
        assert got == expected


def test_sampling(spark):
    df = spark.createDataFrame([(i, "q", i % 2, float(i)) for i in range(10)], "doc_id long, query_name string, label int, score double")
    assert sampling.stratified(df, ["label"], 0.01, 1, ["doc_id"]).count() == 2
    assert sampling.stratified(df, ["label"], 0.5, 1, ["doc_id"]).count() == 4  # halves go to the even number
    q = sampling.acquisition(df.withColumn("score", F.lit(-1.0)), ["query_name"], "score", 0.0)
    assert {round(r.q, 9) for r in q.collect()} == {0.1}
    one = sampling.acquisition(df, ["query_name"], "score", 1.0)
    assert {round(r.q, 9) for r in one.collect()} == {0.1}
    w = sampling.importance(one, ["query_name"])
    assert {round(r.weight, 9) for r in w.collect()} == {1.0}
    capped = sampling.under_confidence(df.withColumn("confidence", F.col("score") / 10), ["query_name"], 0.3, 5, "doc_id")
    assert sorted(r.doc_id for r in capped.collect()) == [0, 1, 2, 3, 4]


def test_logistic_head_equals_direct_inversion():
    rng = np.random.default_rng(0)
    head, precision = learners.LogisticHead.new(5), np.eye(5)
    for _ in range(30):
        phi, y, w = rng.standard_normal(5), float(rng.integers(0, 2)), float(rng.random())
        p = learners.sigmoid(head.score(phi))
        precision += w * p * (1 - p) * np.outer(phi, phi)
        mean = head.mean - np.linalg.inv(precision) @ phi * (w * (p - y))
        head.update(phi, y, w)
        assert np.allclose(head.spread, np.linalg.inv(precision)) and np.allclose(head.mean, mean)
    again = learners.LogisticHead.load(head.dump())
    assert np.allclose(again.mean, head.mean) and again.n == 30
    with pytest.raises(ValueError):
        learners.LogisticHead.load(json.dumps({"mean": [0, 0], "spread": [[1]], "n": 0}))


def test_bandit_and_heads():
    rng = np.random.default_rng(1)
    bandit, a, b = learners.LinearBandit.new(4), np.eye(4), np.zeros(4)
    for _ in range(20):
        phi, r = rng.standard_normal(4), float(rng.random())
        bandit.update(phi, r)
        a, b = a + np.outer(phi, phi), b + r * phi
    x = rng.standard_normal(4)
    assert bandit.score(x) == pytest.approx(x @ np.linalg.solve(a, b) + np.sqrt(x @ np.linalg.solve(a, x)))
    assert np.allclose(learners.credits(np.array([0.3])), [1.0]) and learners.credits(np.array([0.2, 0.9])).sum() == pytest.approx(2)
    heads = learners.SharedHeads(4)
    assert heads.share("q") == 0
    for _ in range(20):
        heads.observe("q", x[None], True)
    assert heads.share("q") == 0.5 and heads.score("q", x) > 0 and heads.score("other", x) == heads.whole.score(x)


def test_refits():
    r = learners.Refits(every=5, least_new=2, least_class=1)
    due = []
    for i in range(12):
        r.point()
        due.append(r.observe([0.0], i % 2))
    assert due == [False] * 4 + [True] + [False] * 4 + [True] + [False] * 2


def test_beta_lower(spark):
    assert baselines.beta_lower(0, 0, 0.9) == pytest.approx(0.1)
    assert baselines.beta_lower(9, 0, 0.95) == pytest.approx(0.05 ** (1 / 10), rel=1e-9)
    for hits, misses in ((3, 2), (500, 20), (40, 0)):
        low = baselines.beta_lower(hits, misses, 0.9)
        assert baselines.reaches(hits, misses, low - 1e-6, 0.9) and not baselines.reaches(hits, misses, low + 1e-6, 0.9)
    rows = [("q", float(i), int(i >= 20)) for i in range(40)] + [("one", 1.0, 1)]
    got = {r.query_name: r for r in baselines.fit_one_rung(spark.createDataFrame(rows, "query_name string, x double, large int"), ["query_name"], 0.8, 0.8, 0.9).collect()}
    assert got["q"].settled > 0.9 and got["q"].low <= got["q"].high and got["one"].settled == 0


def test_one_rung_equals_trying_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = sorted((round(float(rng.normal() + y), 1), int(y)) for y in rng.integers(0, 2, 120))
    xs, ys = [x for x, _ in rows], [y for _, y in rows]
    best = 0.0
    for low in sorted({*xs, 99.0}):
        for high in sorted({-99.0, *xs}):
            below, above = [y for x, y in rows if x < low], [y for x, y in rows if x > high]
            if high < low and max([x for x in xs if x < low], default=-99) > high:
                continue  # the two sides overlap
            ok = (not below or baselines.beta_lower(below.count(0), below.count(1), 0.9) >= 0.7) and (not above or baselines.beta_lower(above.count(1), above.count(0), 0.9) >= 0.7)
            best = max(best, (len(below) + len(above)) / len(xs)) if ok else best
    df = spark.createDataFrame([("q", x, y) for x, y in rows], "query_name string, x double, large int")
    assert baselines.fit_one_rung(df, ["query_name"], 0.7, 0.7, 0.9).first().settled == pytest.approx(best) and sum(ys)


def test_plans_of_several_rungs():
    rng = np.random.default_rng(6)
    gold = rng.integers(0, 2, 200)
    scores = np.array([(gold * 2 - 1) * 1.5 + rng.normal(size=200), (gold * 2 - 1) * 6 + rng.normal(size=200)])
    plan = baselines.fit_rungs(scores, gold, [1.0, 3.0], 100.0, 0.9, 0.9)
    assert plan["feasible"] and plan["esc"] < 0.2 and plan["cost"] < 100 and any(plan["pick"])
    none = baselines.fit_rungs(rng.normal(size=(1, 30)), rng.integers(0, 2, 30), [1.0], 100.0, 0.999, 0.999)
    assert not none["feasible"]


def test_best_threshold_may_take_none(spark):
    df = spark.createDataFrame([(0.9, 0), (0.8, 0), (0.1, 1)], "x double, truth int").selectExpr("'q' AS query_name", "*")
    r = baselines.best_threshold(df, ["query_name"], "x").first()
    assert (r.cut, r.accuracy, r.f1_cut, r.f1) == (None, pytest.approx(2 / 3, abs=1e-6), 0.1, 0.5)


def test_band_and_histogram(spark):
    df = spark.createDataFrame([(0.0, 0), (0.5, 1), (1.0, 1)], "x double, truth int")
    assert [r[0] for r in df.select(baselines.band(F.col("x"), F.lit(0.5), F.lit(1.0))).collect()] == [0, -1, 1]
    assert sorted((r.bin, r.n) for r in baselines.histogram(df, [], "x", 0.0, 1.0, 4).collect()) == [(0, 1), (2, 1), (3, 1)]


def test_ladder(spark):
    df = spark.createDataFrame([(-5.0, 0.0, 1), (2.0, 0.0, 0), (0.0, 9.0, 0), (0.0, 0.0, 1)], "a double, b double, large int")
    got = [(r.rung, r.verdict) for r in baselines.ladder(df, [("a", -1.0, 2.0, True), ("b", -1.0, 1.0, True)]).collect()]
    assert got == [(0, 0), (2, 0), (1, 1), (2, 1)]


def test_synthesis_keeps_confirmed_conditions(spark):
    from siftwise.functions import prompts
    from siftwise.plans import warm_start

    pairs = spark.createDataFrame([(1, "red apple", 2, "blue sky"), (3, "x", 4, "y")], "doc_id long, text string, other_id long, other_text string")
    texts = {r.doc_id: r for r in pairs.withColumn("p", prompts.predicate_from_pair(F.col("text"), F.col("other_text"))).withColumn("q", prompts.confirm(F.lit("Names fruit."), F.col("text"))).collect()}
    answers = {texts[1].p: 'Sure: {"condition": "Names fruit."}', texts[1].q: "Yes.", texts[3].p: "no idea"}
    got = warm_start.synthesize(pairs, lambda: clients.Replay(answers, "No")).collect()
    assert sorted((r.predicate, r.doc_id, r.expected_answer) for r in got) == [("Names fruit.", 1, "Yes"), ("Names fruit.", 2, "No")]
    docs = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    spread = warm_start.spread(spark.createDataFrame([("p",), ("q",)], "predicate string"), docs, 5, 1)
    assert spread.count() == 10 and spread.select("cand_id").distinct().count() == 10


def test_bm25_of_hits_scores_only_hits(spark):
    """The scores that bm25 gives, for the lessons a document hit alone, and 0 where it gives none."""
    words = "red green blue round square large".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i + j) % 6] for j in range(i % 4))) for i in range(12)], "doc_id long, text string")
    pool = spark.createDataFrame([(f"e{i}", " ".join(words[i : i + 2]), words[5 - i]) for i in range(5)], "experience_id string, one string, two string")
    hits = spark.createDataFrame([(i, f"e{(i + j) % 5}", j) for i in range(12) for j in range(2)], "doc_id long, experience_id string, rank int")
    told = {(r.doc_id, r.experience_id): (r.rank, r.a, r.b) for r in retrieval.bm25_of_hits(hits, docs, pool, {"one": "a", "two": "b"}).collect()}
    assert len(told) == 24
    for n, column in enumerate(("one", "two")):
        every = {(r.doc_id, r.experience_id): r.bm25 for r in retrieval.bm25(docs, pool, column).collect()}
        for k, v in told.items():
            assert v[n + 1] == pytest.approx(every.get(k, 0.0), abs=1e-12) and v[0] == (int(k[1][1]) - k[0]) % 5


def test_hits_carry_only_what_is_kept_and_meet_the_pool_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "doc_id long, vec array<double>")
    pool = spark.createDataFrame([(f"e{i}", "q", rng.normal(size=4).tolist()) for i in range(9)], "experience_id string, source_query string, vec array<double>")
    whole = retrieval.top_k(points, pool, ["doc_id"], 3)
    own = sorted(map(tuple, whole.drop("vec").collect()))
    monkeypatch.setattr(retrieval, "SLICE", 2)
    few = retrieval.top_k(points, pool, ["doc_id"], 3, keep=["doc_id"])
    assert "vec" not in few.columns and sorted(map(tuple, few.collect())) == own
    monkeypatch.setattr(retrieval, "SENT_POOL", 4)
    assert sorted(map(tuple, retrieval.top_k(points, pool, ["doc_id"], 3, keep=["doc_id"]).select(few.columns).collect())) == own


def test_demonstrations_move_each_row_once(spark, monkeypatch):
    """Points and records are not copied for every pair of blocks; blocks of any size, with ties and gaps, give the same rows as all pairs."""
    rng = np.random.default_rng(5)
    rows = [("pq"[i % 2], int(d), int(p), rng.integers(-2, 3, 3).astype(float).tolist(), ("Yes", "No", "UNKNOWN")[i % 3]) for i, (d, p) in enumerate(zip(rng.integers(0, 9, 60), rng.permutation(600)[:60], strict=True))]
    df = spark.createDataFrame(rows, "query_name string, doc_id long, pos long, vec array<double>, prediction string")
    expected = []
    for q, d, p, v, _ in rows:
        near = sorted(((-float(np.dot(v, w)), e), label) for r, e, o, w, label in rows if r == q and e != d and o < p and label != "UNKNOWN")
        expected += [(q, d, p, -x[0], n) for n, (x, _) in enumerate(near[:2])]
    for packed in (4, 1000):
        monkeypatch.setattr(retrieval, "PACKED", packed)
        out = retrieval.demonstrations(df, df, 2, block=7)
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.query_name, r.doc_id, r.pos, r.cos, r["rank"]) for r in out.collect()) == sorted(expected)


def test_orders_settle_no_texts(spark, small_dir, monkeypatch):
    from siftwise.plans import registry

    seen, settled = [], prefix.settled
    monkeypatch.setattr(prefix, "settled", lambda df: seen.append(df.columns) or settled(df))
    registry.points_ordered(spark, small_dir)
    assert seen and not any("text" in c for c in seen)
