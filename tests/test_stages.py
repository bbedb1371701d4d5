"""Stages against a local server that speaks the chat JSON."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from siftwise import cli
from siftwise.functions import prompts
from siftwise.operators import routing
from siftwise.plans import cascade, stages
from siftwise.sources import cache, clients, config


class Model(BaseHTTPRequestHandler):
    calls: list[dict] = []

    def log_message(self, *args):
        pass

    def do_GET(self):
        self.send_response(200)
        self.end_headers()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("/embed"):
            return self.reply({"embeddings": [[float(len(t)), float("red" in t)] for t in body["texts"]]})
        Model.calls.append(body)
        last = body["messages"][-1]["content"]
        if "broken" in last:
            self.send_response(500)
            return self.end_headers()
        red = "red" in last.rsplit("Document", 1)[-1]
        if "Reply with JSON {" in last:
            text, top = '{"lesson": "Mind the colour.", "when": "always"}', []
        elif "In two sentences" in last:
            text, top = "Because of a word.", []
        elif "Verdict:" in last:
            text, top = "Correct", []
        elif body["model"] == "small":
            shown = "Lessons" in body["messages"][0]["content"]
            text = "True" if red else "Unsure"
            top = [{"token": "True", "logprob": -0.1 if red else -2.0}, {"token": " False", "logprob": -1.0}, {"token": "Un", "logprob": -3.0 if red or shown else -0.2}]
        else:
            text, top = "Yes" if red else "No", []
        content = [{"token": top[0]["token"], "logprob": top[0]["logprob"], "top_logprobs": top}] if top and body.get("logprobs") else []
        n = body.get("n", 1)
        return self.reply({"choices": [{"message": {"content": text}, "logprobs": {"content": content}} for _ in range(n)], "usage": {"prompt_tokens": 7, "completion_tokens": n}})

    def reply(self, value):
        data = json.dumps(value).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


@pytest.fixture
def points(spark):
    rows = [(1, "colour", "Names a colour.", "a red hat", "Yes"), (2, "colour", "Names a colour.", "a hat", "No"), (3, "colour", "Names a colour.", "broken", "No")]
    return spark.createDataFrame(rows, "doc_id long, query_name string, query_description string, text string, ground_truth string").withColumn("pos", F.col("doc_id"))


def test_small_and_large(spark, url, points):
    Model.calls.clear()
    chat = lambda name: lambda: clients.HttpChat(url, name, wait=0.0)
    asked = points.withColumn("lessons", F.array(F.lit("Look twice."))).withColumn("demos", F.array(F.struct(F.lit("a blue cap").alias("text"), F.lit("Yes").alias("label"))))
    r = {x.doc_id: x for x in cascade.settled(stages.small(asked, chat("small"))).collect()}
    assert (r[1].small_prediction, r[2].small_prediction, r[3].small_prediction) == ("Yes", "No", "UNKNOWN") and r[1].logprobs_available and not r[3].logprobs_available
    assert r[3].small_error and r[1].small_in == 7 and r[1].logprob_no == -1.0 and r[1].confidence == max(r[1].p_yes, r[1].p_no)
    sent = next(c for c in Model.calls if "a red hat" in c["messages"][-1]["content"])["messages"]
    assert [m["role"] for m in sent] == ["system", "user", "assistant", "user"] and "1. Look twice." in sent[0]["content"] and sent[2]["content"] == "True"
    Model.calls.clear()
    big = {x.doc_id: x.large_prediction for x in cascade.settled(stages.large(points, chat("large"))).collect()}
    assert big == {1: "Yes", 2: "No", 3: None} and all(len(c["messages"]) == 2 and "logprobs" in c for c in Model.calls)
    assert stages.small(points, chat("small"), "two").select("small_prediction", "entropy_2way").first() is not None


def test_filter_with_write_back(spark, url, points, tmp_path):
    Model.calls.clear()
    chat = lambda name: lambda: clients.HttpChat(url, name, wait=0.0)
    r = cascade.semantic_filter(points, lambda p: stages.small(p, chat("small")), lambda p: stages.large(p, chat("large")), routing.by_confidence(0.5), store=lambda rows: cache.append(rows, f"{tmp_path}/cache"))
    got = {x.doc_id: (x.escalated, x.prediction) for x in r.collect()}
    assert got == {1: (False, "Yes"), 2: (True, "No"), 3: (True, "UNKNOWN")}
    again = cache.merge(cache.read(spark, f"{tmp_path}/cache"))
    assert [(x.doc_id, x.prediction) for x in again.collect()] == [(2, "No")]


def test_lessons_votes_and_collectors(spark, url, points):
    chat = lambda name, **k: lambda: clients.HttpChat(url, name, wait=0.0, **k)
    t = points.withColumns({"small_prediction": F.lit("No"), "large_prediction": F.lit("Yes")})
    log = cascade.settled(stages.explained(t, chat("small"), chat("large"), lambda: clients.HttpEmbed(url)))
    got = {x.doc_id: x for x in log.collect()}
    assert got[1].status == "accepted" and got[1].experience_text == "Mind the colour." and got[1].vec == [16.0, 0.0] and got[3].status == "error"
    s = stages.generation_stats(log).first()
    assert (s.attempted, s.succeeded, s.llm_errors, s.explain_in) == (3, 2, 1, 14)
    told = points.withColumn("small_prediction", F.when(F.col("doc_id") == 2, "Unsure").otherwise("Yes"))
    v = {x.doc_id: x for x in routing.with_verification(told, lambda d: stages.votes(d, chat("small", extra={"n": 3})), 3).collect()}
    assert (v[1].verify_score, v[1].verify_out, v[2].verify_score, v[3].verify_score, v[3].verify_calls) == (1.0, 3, None, 0.0, 3)
    c = {x.doc_id: x.prediction for x in stages.all_answers(points, None, chat("large")).collect()}
    assert c == {1: "Yes", 2: "No", 3: "UNKNOWN"}
    done = spark.createDataFrame([("colour", 1), ("colour", 3)], "query_name string, doc_id long")
    assert [x.doc_id for x in stages.all_answers(points, done, chat("small"), "json").collect()] == [2]
    with pytest.raises(KeyError, match="known"):
        prompts.zero_shot(F.lit(""), F.lit(""), "none")


def test_embedding_cache(spark, url, tmp_path):
    docs = spark.createDataFrame([(1, "red"), (2, "blue")], "doc_id long, text string")
    at = f"{tmp_path}/vectors"
    clients.embedded(docs.limit(1), at, lambda: clients.HttpEmbed(url)).collect()
    assert {x.doc_id: x.vec for x in clients.embedded(docs, at, lambda: clients.HttpEmbed(url)).collect()} == {1: [3.0, 1.0], 2: [4.0, 0.0]}
    assert spark.read.parquet(at).count() == 2


def test_plans_from_settings(url):
    run = config.build(config.Run, {"output": "o", "router": {"name": "lightgbm", "threshold": 0.6}, "retrieval": {"name": "care_pq", "k": 4}, "generation": {"name": "online_discrepancy", "rho": 2.0}})
    models = config.Models(small_url=url, small_model="small", large_url=url, large_model="large")
    plan = stages.plan(run, models)
    assert (plan.router, plan.threshold, plan.rho) == ("learned", 0.6, 2.0) and plan.generate is not None and stages.policy(run.retrieval).method == "care_pq"
    with pytest.raises(SystemExit, match="unreachable"):
        stages.plan(run, config.Models(small_url="http://127.0.0.1:9", large_url=url))
    with pytest.raises(KeyError, match="known"):
        stages.policy(config.Retrieval("nothing"))
    assert routing.needs_large("all_small", True) and not routing.needs_large("all_small") and clients.default_client({}) == "http"


def test_command_line_runs_a_settings_file(spark, url, tmp_path):
    (tmp_path / "d.csv").write_text("document_id,document_name,text\n1,a,a red hat\n2,b,a hat\n3,c,red red\n")
    (tmp_path / "p.csv").write_text("document_id,query_name,ground_truth\n1,colour,Yes\n2,colour,No\n3,colour,Yes\n")
    (tmp_path / "q.csv").write_text("query_name,query_description\ncolour,Names a colour.\n")
    data = {k: f"{tmp_path}/{k[0]}.csv" for k in ("documents", "pairs", "queries")}
    settings = {"output": f"{tmp_path}/out", "epoch": 2, "router": {"name": "confidence_threshold", "threshold": 0.5}, "retrieval": {"name": "care", "k": 2}, "generation": {"name": "online_discrepancy"}, "data": data,
                "models": {"small_url": url, "small_model": "small", "large_url": url, "large_model": "large", "embed_url": url, "cache_to": f"{tmp_path}/cache"}}
    (tmp_path / "c.json").write_text(json.dumps(settings))
    assert cli.main(["run", "--config", f"{tmp_path}/c.json", "--set", "order=doc_id"]) == 0
    r = {x.doc_id: (x.prediction, x.routed_to) for x in spark.read.parquet(f"{tmp_path}/out/records").collect()}
    assert r == {1: ("Yes", "small"), 2: ("No", "large"), 3: ("Yes", "small")}
    assert spark.read.json(f"{tmp_path}/out/overall").first().accuracy == 1.0 and cache.merge(cache.read(spark, f"{tmp_path}/cache")).count() == 1
