"""Registered queries against their SQL, batch against stream."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from siftwise.plans import registry

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CHECKED = (
    "cascade_confidence", "metrics_per_query", "point_scan", "parse_yes_no", "parse_3way", "parse_zero_shot", "parse_json", "features_collector", "prompt_small", "cache_stats", "cost_abort",
    "topk_cosine", "helpfulness_rerank", "router_signals", "phi_features", "point_features", "best_threshold", "fewshot_topk", "mmr_select", "bm25_score", "query_history", "generation_cap", "stratified_sample", "conf_cap", "scaledoc_sweep", "taskcascade_replay",
)


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 8) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, small_dir, name):
    df = registry.queries()[name](spark, small_dir)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "doc_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
