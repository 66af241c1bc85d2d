import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["scan_papers", "q_sparse_paragraph", "topk_padded", "q_dense_paper_mean", "q_rerank_paper", "q_evaluate", "training_rows", "index_shards"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "events", "nation", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = entry.queries()[name](spark, DIR)
    want = con.sql(entry.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    shown = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert shown(tuple(r) for r in got.select(*order).collect()) == shown(want.select(*[f'"{c}"' for c in order]).fetchall())


def test_sql_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(NAMES) > 70
