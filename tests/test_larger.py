"""What larger tables bring up: signs of zero, texts and vectors met once, rankings that each task cuts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternrank.functions.vectors import l2_normalize, rounded


def test_rounding_keeps_the_sign_of_zero(spark):
    rows = spark.createDataFrame([([-1e-9, 1e-9, -0.5, 0.25, 0.0],)], "v array<double>")
    got = rows.select(F.transform("v", lambda x: rounded(x)).alias("v")).first().v
    assert got == [0.0, 0.0, -0.5, 0.25, 0.0] and [math.copysign(1, x) for x in got] == [-1, 1, -1, 1, 1]


def test_normalising_meets_a_vector_once(spark):
    times = spark.sparkContext.accumulator(0)

    def met(v):
        times.add(1)
        return v

    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0])], "id long, v array<double>")
    out = rows.coalesce(1).select("id", l2_normalize(F.col("v")).alias("u"))
    assert {r.id: r.u for r in out.collect()} == {1: [0.6, 0.8], 2: None, 3: [0.0, 0.0]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.index("aggregate(") < plan.index("greatest(")  # the norm stands outside the loop over positions


def test_term_vectors_make_no_row_a_term(spark):
    from lanternrank.operators import encoders as E

    words = ["ä", "b", "cc", "Zz", "e\tb"]
    rows = [(f"{i % 40}_{i % 7}", " ".join(words[(i * j) % 5] for j in range(i % 9))) for i in range(400)] + [("x_0", None), ("x_1", " \t")]
    df = spark.createDataFrame(rows, "docid string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # an item's rows stand in several batches
    try:
        out = E.term_vectors(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.docid: dict(zip(r.terms, np.round(r.weights, 9))) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for r in E.term_weights(df).collect():
        want.setdefault(r.docid, {})[r.term] = round(r.weight, 9)
    assert got == want
    assert "Generate explode" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_hashed_vectors_move_texts_once(spark):
    from lanternrank.operators import encoders as E

    df = spark.createDataFrame([("a", "x y x"), ("b", " "), ("c", "z")], "docid string, text string")
    out = E.hashed(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    load = E.hashed_loader()()
    got = {r.docid: r.vector for r in out.collect()}
    assert set(got) == {"a", "c"} and all(np.allclose(got[d], load([t])[0]) for d, t in (("a", "x y x"), ("c", "z")))
    assert plan.count("Exchange hashpartitioning") == 1


def test_sparse_scores_exchange_nothing(spark, tmp_path):
    from lanternrank.operators import encoders as E
    from lanternrank.operators import ranking as R
    from lanternrank.sources.indexes import build_sparse, update_sparse

    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"w{int(x)}" for x in rng.zipf(1.6, 8) % 50)
    rows = [(f"p{i // 4}_{i % 4}", text()) for i in range(300)]
    topics = spark.createDataFrame([(f"q{i}", text()) for i in range(5)] + [("none", "absent")], "qid string, query string")
    terms = E.term_weights(topics.withColumnRenamed("query", "text"), "qid")
    build_sparse(spark.createDataFrame(rows, "docid string, text string"), f"file://{tmp_path}/i", "s")
    now = spark.createDataFrame([(d, t if not d.startswith("p7_") else t + " w1 w2") for d, t in rows if not d.startswith("p9_")], "docid string, text string")
    index = update_sparse(now, f"file://{tmp_path}/i", "s", whole=True)
    found = index.scores(terms, "paragraph")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    postings = E.term_weights(now)
    want = {(r.qid, r.docid): round(r.score, 9) for r in R.sparse_cosine(terms, postings).collect()}
    assert {(r.qid, r.docid): round(r.score, 9) for r in found.collect()} == want and want
    assert {(r.qid, r.docid): round(r.score, 9) for r in index.scores(terms, "paragraph", body=True).collect()} == {k: v for k, v in want.items() if not k[1].endswith("_0")}
    dots = {(r.qid, r.docid): round(r.dot, 9) for r in index.dots(terms, "paragraph").collect()}
    assert dots == {(r.qid, r.docid): round(r.dot, 9) for r in R.sparse_dot(terms, postings).collect()}
    ranked = lambda df, item: sorted((r.qid, r[item], round(r.score, 9), r["rank"]) for r in df.collect())
    assert ranked(index.best(terms, "paragraph", k=7), "docid") == ranked(R.rank(index.scores(terms, "paragraph", body=True), k=7), "docid")
    assert ranked(index.best(terms, "paper", k=7), "paper_id") == ranked(R.rank(R.maxp(found), "paper_id", k=7), "paper_id")


@pytest.mark.parametrize("batch", [3, 10_000])
def test_dense_tasks_keep_the_best_of_all_their_rows(spark, monkeypatch, batch):
    from lanternrank.operators import ranking as R

    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (240, 4)).astype(float)  # scores with many ties
    corpus = spark.createDataFrame([(f"p{i // 5}_{i % 5}", f"p{i // 5}", v.tolist()) for i, v in enumerate(vectors)] + [("null_0", "null", None)], "docid string, paper_id string, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(7)], "qid long, vector array<double>")
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        shown = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
        every = R.dense_scores(queries, corpus, group="paper_id")
        top = R.dense_scores(queries, corpus.repartition(4), k=6)
        counts = {(r.p, r.qid): r.n for r in top.groupBy(F.spark_partition_id().alias("p"), "qid").agg(F.count("*").alias("n")).collect()}
        assert set(counts.values()) == {6} and len(counts) == 4 * 7  # k rows a task and query, however many batches it met
        assert shown(R.rank(top, k=6), "qid", "docid", "score", "rank") == shown(R.rank(every, k=6), "qid", "docid", "score", "rank")
        best = R.dense_best_passages(queries, corpus)
        assert shown(best, "qid", "paper_id", "docid", "score") == shown(R.best_passage(every), "qid", "paper_id", "docid", "score")
        cut = R.rank(R.dense_best_passages(queries, corpus, 6), "paper_id", k=6)
        assert shown(cut, "qid", "paper_id", "docid", "rank") == shown(R.rank(R.best_passage(every), "paper_id", k=6), "qid", "paper_id", "docid", "rank")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_best_passages_move_vectors_alone(spark):
    from lanternrank.operators import ranking as R

    rows = spark.createDataFrame([("a_0", "a", [1.0, 0.0]), ("a_1", "a", [0.0, 1.0])], "docid string, paper_id string, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.5])], "qid long, vector array<double>")
    plan = R.dense_best_passages(queries, rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and plan.count("Exchange") == 1 and "qid" not in plan[plan.index("Exchange"):]


def test_small_numbers_in_reports(spark):
    import json

    from lanternrank.sources import corpus as C

    rows = [("full", 1, m, v) for m, v in (("a", 0.000123), ("b", 0.0005), ("c", 0.001), ("d", 0.000001), ("e", 0.25), ("f", 1.0), ("g", 0.0))]
    df = spark.createDataFrame(rows, "run string, level int, metric string, value double")
    assert C.report_json(df).first().report == '{"a":0.000123,"b":0.0005,"c":0.001,"d":0.000001,"e":0.25,"f":1.0,"g":0.0}'
    name = 'x:1.5E-4,"\\ y'
    values = df.withColumn("run", F.lit(name)).withColumn("qid", F.lit(7))
    told = C.query_report(values, {"set": name}).first().report
    assert "0.000123" in told and json.loads(told)["set"] == name
    assert json.loads(told)["relevance_passes"]["relevant_or_partial"]["queries"]["7"][name]["b"] == 0.0005


def test_sums_of_papers_move_a_row_a_batch(spark):
    from lanternrank.sources.indexes import states

    rng = np.random.default_rng(2)
    rows = [(f"p{i % 11}", rng.normal(size=3).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "paper_id string, vector array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        out = states(df)
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.paper_id: (r.n, r.total) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {p for p, _ in rows}
    for p, (n, total) in got.items():
        mine = [v for q, v in rows if q == p]
        assert n == len(mine) and np.allclose(total, np.sum(mine, axis=0))


def test_judgments_are_counted_before_they_move(spark):
    from lanternrank.operators import metrics as M

    rng = np.random.default_rng(8)
    rows = [(f"q{q}", f"d{i}", int(g)) for q in range(6) for i, g in enumerate(rng.integers(0, 4, 3 * q + 1))] + [("none", "d0", 0), ("one", "d0", None), ("one", "d1", 2)]
    out = M.ideal(spark.createDataFrame(rows, "qid string, docid string, rel int"))
    assert "docid" not in out._jdf.queryExecution().executedPlan().toString().split("== Initial")[0].split("Exchange", 1)[1].split("Scan")[0]
    got = {r.qid: (r["all"], r.five) for r in out.collect()}
    assert set(got) == {q for q, _, _ in rows}
    for q, (every, five) in got.items():
        gains = [g / math.log2(p + 2) for p, g in enumerate(sorted((g or 0 for x, _, g in rows if x == q), reverse=True))]
        assert math.isclose(every, sum(gains), abs_tol=1e-12) and math.isclose(five, sum(gains[:5]), abs_tol=1e-12)


def test_judgments_stream_past_ranked_rows(spark):
    from lanternrank.operators import metrics as M

    runs = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2), ("b", 1, "x", 1), ("a", 2, "x", 1)], "run string, qid long, docid string, rank int")
    qrels = spark.createDataFrame([(1, "x", 2), (1, "z", 1), (3, "x", 1)], "qid long, docid string, rel int")
    out = M.judged(runs, qrels)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin [qid" in plan and "BuildLeft" in plan
    assert sorted((r.run, r.qid, r.docid, r.rel) for r in out.collect()) == [("a", 1, "x", 2), ("a", 1, "y", 0), ("b", 1, "x", 2)]


@pytest.mark.parametrize("name", ["ndcg5", "metrics_graded", "pairwise_compare"])
def test_metrics_search_once(spark, name):
    import __spark_entry__

    out = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # the runs are a written table


def test_what_a_dense_task_holds_is_bounded(spark):
    import pyarrow as pa

    from lanternrank.operators.ranking import _Top

    rng, top = np.random.default_rng(4), _Top(5, 3, ["docid"])
    every = [(rng.integers(-2, 3, (5, 40)).astype(float), [f"d{at}_{i:02}" for i in range(40)]) for at in range(60)]
    for scores, names in every:
        top.add(scores, [pa.array(names)])
        assert top.rows <= 2 * 5 * 3  # however many rows a task has met, and however many tie
    got = [tuple(x) for b in top.batches(pa.array(range(5))) for x in zip(*(c.to_pylist() for c in b.columns))]
    want = [(q, n, s[q][i]) for q in range(5) for s, ns in every for i, n in enumerate(ns)]
    assert sorted(got) == sorted(x for q in range(5) for x in sorted((w for w in want if w[0] == q), key=lambda w: (-w[2], w[1]))[:3])


def test_many_dense_queries_share_a_reading_of_the_blocks(spark, monkeypatch):
    from lanternrank.operators import blocks as B
    from lanternrank.operators import ranking as R

    rng = np.random.default_rng(6)
    rows = [(f"p{i // 5}_{i % 5}", f"p{i // 5}", v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (700, 4)).astype(float))]
    corpus = spark.createDataFrame(rows, "docid string, paper_id string, vector array<double>").repartition(3).cache()
    queries = spark.createDataFrame([(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(30)], "qid long, vector array<double>")
    monkeypatch.setattr(B, "GROUP", 4)
    monkeypatch.setattr(B, "STEP", 6)
    monkeypatch.setattr(B, "DENSE_GROUP", 16)
    monkeypatch.setattr(B, "DENSE_SIZE", 8)
    packed = B.pack_dense(corpus, 8).cache()
    found = B.dense_search(packed, queries, "docid", 7)
    tops = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.startswith((":- MapInArrow", "+- MapInArrow"))]
    assert len(tops) == 2  # groups of 16 queries, not of 4
    shown = lambda df: sorted((r.qid, r.docid, round(r.score, 9), r["rank"]) for r in df.collect())
    assert shown(R.rank(found.drop("paper_id"), k=7)) == shown(R.rank(R.dense_scores(queries, corpus), k=7))


@pytest.mark.parametrize("batch", [3, 10_000])
def test_dense_tasks_keep_scores_that_are_no_numbers(spark, batch):
    from lanternrank.operators import ranking as R

    rng, nan, inf = np.random.default_rng(9), math.nan, math.inf
    vectors = rng.integers(-2, 3, (60, 3)).astype(float)
    for i, x in ((7, nan), (8, inf), (21, inf), (33, -inf), (41, nan)):
        vectors[i, 1] = x
    corpus = spark.createDataFrame([(f"p{i // 5}_{i % 5}", f"p{i // 5}", v.tolist()) for i, v in enumerate(vectors)], "docid string, paper_id string, vector array<double>").repartition(2)
    queries = spark.createDataFrame([(0, [1.0, 2.0, -1.0]), (1, [nan, 1.0, 0.0]), (2, [1.0, 0.0, 1.0]), (3, [0.0, -1.0, inf]), (4, [2.0, -1.0, 0.0])], "qid long, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        shown = lambda df, *c: sorted(tuple(str(r[x]) for x in c) for r in df.collect())
        every = R.dense_scores(queries, corpus, group="paper_id")
        top = R.rank(R.dense_scores(queries, corpus, k=6), k=6)
        assert top.count() == 5 * 6  # queries of nothing but NaN too
        assert shown(top, "qid", "docid", "score", "rank") == shown(R.rank(every, k=6), "qid", "docid", "score", "rank")
        scores = {}
        for r in every.collect():
            scores.setdefault((r.qid, r.paper_id), []).append((r.docid, r.score))
        best = {k: (min(v, key=lambda x: (math.isnan(x[1]), 0 if math.isnan(x[1]) else -round(x[1], 9), x[0]))[0], max(v, key=lambda x: (math.isnan(x[1]), x[1]))[1]) for k, v in scores.items()}
        found = R.dense_best_passages(queries, corpus)
        assert shown(found, "qid", "paper_id", "docid", "score") == sorted((str(q), p, d, str(x)) for (q, p), (d, x) in best.items())
        cut = R.rank(R.dense_best_passages(queries, corpus, 6), "paper_id", k=6)
        assert shown(cut, "qid", "paper_id", "docid", "score", "rank") == shown(R.rank(found, "paper_id", k=6), "qid", "paper_id", "docid", "score", "rank")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_add_no_more_than_k_rows_a_query():
    import pyarrow as pa

    from lanternrank.operators.ranking import _Top

    met = []

    class Told(_Top):
        def cut(self):
            met.append(self.rows)
            super().cut()

    top, scores = Told(5, 3, ["docid"]), np.zeros((5, 400))
    scores[1, 399] = 1.0
    for at in (1, 0, 2, 3):
        top.add(scores, [pa.array([f"d{at}_{i:03}" for i in range(400)])])
    got = sorted(tuple(x) for b in top.batches(pa.array(range(5))) for x in zip(*(c.to_pylist() for c in b.columns)))
    assert max(met) <= 3 * 5 * 3
    assert [d for q, d, _ in got if q != 1] == ["d0_000", "d0_001", "d0_002"] * 4
    assert [d for q, d, _ in got if q == 1] == ["d0_399", "d1_399", "d2_399"]


def test_a_written_run_keeps_scores_that_are_no_numbers(spark, tmp_path):
    from lanternrank.operators import ranking as R
    from lanternrank.sources import corpus as C

    rows = [(f"p{i}", [float(i), math.nan if i in (2, 30) else 1.0]) for i in range(40)]
    corpus = spark.createDataFrame(rows, "docid string, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 1.0]), (1, [math.nan, 0.0])], "qid long, vector array<double>")
    run = R.rank(R.dense_scores(queries, corpus, k=3), k=3).select(F.lit("full").alias("run"), "qid", "docid", "score", "rank")
    C.write_run(run, f"file://{tmp_path}/run")
    got = sorted((r.qid, r["rank"], r.docid, str(r.score)) for r in C.read_run(spark, f"file://{tmp_path}/run").collect())
    assert got == [("0", 1, "p2", "nan"), ("0", 2, "p30", "nan"), ("0", 3, "p39", "40.0"), ("1", 1, "p0", "nan"), ("1", 2, "p1", "nan"), ("1", 3, "p10", "nan")]


def test_a_written_run_rounds_as_its_sql(spark, tmp_path):
    from lanternrank.sources import corpus as C

    scores = [x / 128 for x in range(-9, 10)] + [-0.0, -1e-9, 1e-9, 0.0000015, 12345.6789, 1e15, -math.inf, math.nan]
    run = spark.createDataFrame([("r", i, f"d{i}", i + 1, s) for i, s in enumerate(scores)], "run string, qid long, docid string, rank int, score double")
    C.write_run(run, f"file://{tmp_path}/run")
    got = {int(r.qid): str(r.score) for r in C.read_run(spark, f"file://{tmp_path}/run").collect()}
    assert got == {i: str(float("%.6f" % s)) for i, s in enumerate(scores)}
    assert {r.qid: r.line for r in C.run_lines(run).collect()} == {i: f"{i} Q0 d{i} {i + 1} {'%.6f' % s} r" for i, s in enumerate(scores)}


@pytest.mark.parametrize("k", [2, 6, None])
def test_pairs_without_a_vector_come_last(spark, tmp_path, k):
    from lanternrank.operators import ranking as R
    from lanternrank.sources import corpus as C

    vectors = [[1.0], None, [3.0], [-1.0], None, [math.nan], None, [2.0]]
    corpus = spark.createDataFrame([(f"d{i}", v) for i, v in enumerate(vectors)], "docid string, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0]), (2, None), (3, [-1.0])], "qid long, vector array<double>")
    want = {1: ["d5", "d2", "d7", "d0", "d3", "d1", "d4", "d6"], 2: [f"d{i}" for i in range(8)], 3: ["d5", "d3", "d0", "d7", "d2", "d1", "d4", "d6"]}
    top = R.dense_top(queries, corpus, k)
    got = {(r.qid, r["rank"]): (r.docid, r.score is None) for r in top.collect()}
    assert got == {(q, i + 1): (d, q == 2 or vectors[int(d[1])] is None) for q, ds in want.items() for i, d in enumerate(ds[:k])}
    C.write_run(top.withColumn("run", F.lit("full")), f"file://{tmp_path}/run")
    back = {(int(r.qid), r["rank"]): (r.docid, r.score is None) for r in C.read_run(spark, f"file://{tmp_path}/run").collect()}
    assert back == got
    assert C.run_lines(top.withColumn("run", F.lit("full"))).where("line is null").count() == sum(none for _, none in got.values())


def test_run_roundtrip_keeps_rows_without_vectors(spark, tmp_path):
    import __spark_entry__

    rows = [(i, None if i in (25, 7, 51) else [((i * j) % 17 - 8) / 16 for j in range(64)], i % 3) for i in range(75)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()["run_roundtrip"](spark, str(tmp_path)).collect()]
    want, ids = [], {f"{i // 5}_{i % 5}": v for i, v, _ in rows if i % 25}
    for run, n in (("full", 64), ("half", 32)):
        for q in (0, 25, 50):
            dots = {d: None if rows[q][1] is None or v is None else sum(a * b for a, b in zip(rows[q][1][:n], v[:n])) for d, v in ids.items()}
            order = sorted(dots, key=lambda d: (dots[d] is None, -(dots[d] or 0), d))[:100]
            want += [(run, str(q), d, i + 1, None if dots[d] is None else float("%.6f" % dots[d])) for i, d in enumerate(order)]
    assert len(want) == 2 * 3 * 72 and sorted(got, key=str) == sorted(want, key=str)


def test_chunk_means_move_texts_once(spark):
    from lanternrank.operators import encoders as E

    words = ["ä", "b", "cc", "Zz", "e\tb"]
    rows = [(f"{i % 150}_1", " ".join(words[(i * j) % 5] for j in range(i % 13))) for i in range(200)] + [("x_0", None), ("x_1", " \t"), (None, "b b cc")]
    df = spark.createDataFrame(rows, "docid string, text string")
    want = {(r.docid, r.term): round(r.weight, 9) for r in E.mean_pool(E.chunk_weights(df.where("docid is not null"), 3)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # an item's rows stand in several batches
    try:
        out = E.chunk_means(df, 3)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r.docid, r.term): round(r.weight, 9) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: v for k, v in got.items() if k[0]} == want
    assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan


def test_chunk_mean_pool_query_has_one_exchange(spark):
    from lanternrank.plans import catalog

    plan = catalog.QUERIES["chunk_mean_pool"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_an_index_has_the_levels_it_was_made_for(spark, tmp_path):
    from lanternrank.operators import encoders as E
    from lanternrank.sources import workspace
    from lanternrank.sources.indexes import merge_sparse, update_sparse

    folder, frame = f"file://{tmp_path}/i", lambda rows: spark.createDataFrame(rows, "docid string, text string")
    rows = [(f"p{i // 3}_{i % 3}", f"w{i % 5} w{i % 7}") for i in range(30)]
    update_sparse(frame(rows[:24]), folder, "s", levels=("paragraph",))
    index = merge_sparse(update_sparse(frame([(d, f"{t} more" if d.startswith("p1_") else t) for d, t in rows]), folder, "s"))
    assert index.levels == ("paragraph",) and index.papers() == 10 and index.items("paragraph").count() == 30
    assert not workspace.exists(spark, f"{folder}/blocks/level=paper") and not workspace.exists(spark, f"{folder}/items/level=paper")
    index.check("paragraph", papers=10)
    topics = frame([("q", "w1 more")])
    terms = E.term_weights(topics.withColumnRenamed("docid", "qid"), "qid")
    assert index.search(topics.withColumnRenamed("docid", "qid"), terms, "paragraph", k=3).count() == 3
    for ask in (lambda: index.check("paper"), lambda: index.search(topics, terms, "paper")):
        with pytest.raises(ValueError, match="was made for"):
            ask()
    with pytest.raises(ValueError, match="levels"):
        update_sparse(frame(rows), folder, "s", levels=("paper",))


def test_followed_queries_build_no_other_index(spark, monkeypatch):
    from lanternrank.plans import catalog
    from lanternrank.plans.bindings import Tables

    def other(*_):
        raise AssertionError("another index")

    monkeypatch.setattr(Tables, "index", other)
    monkeypatch.setattr("lanternrank.sources.indexes._pool", other)
    path = "/root/testdata/sf0.001"
    assert catalog.QUERIES["q_followed_paragraph"](spark, path).count() == 100 * Tables(spark, path).topics().count()
    assert catalog.QUERIES["paper_prints"](spark, path).count() == Tables(spark, path).papers_with_passages()


def test_ranks_of_all_pairs_move_no_pair(spark, tmp_path, monkeypatch):
    from lanternrank.operators import blocks as B
    from lanternrank.operators import encoders as E
    from lanternrank.operators import ranking as R
    from lanternrank.sources.indexes import build_sparse, update_sparse

    monkeypatch.setattr(B, "SLAB", 16)  # tasks get it with the function that packs
    monkeypatch.setattr(B, "GROUP", 4)
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{int(x)}" for x in rng.zipf(1.6, 6) % 12)
    rows = [(f"p{i // 4}_{i % 4}", text() if i % 3 else "w1 w2") for i in range(300)] + [("long_1", " ".join(f"w{i}" for i in range(12)))]
    topics = spark.createDataFrame([(f"q{i}", text()) for i in range(6)] + [("none", "absent")], "qid string, text string")
    terms = E.term_weights(topics, "qid")
    build_sparse(spark.createDataFrame(rows, "docid string, text string"), f"file://{tmp_path}/i", "s")
    index = update_sparse(spark.createDataFrame([(d, t if not d.startswith("p7_") else t + " w1") for d, t in rows if not d.startswith("p9_")], "docid string, text string"), f"file://{tmp_path}/i", "s", whole=True)
    for body in (True, False):
        found = index.ranked(terms, "paragraph", body)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning(qid" not in plan
        got = {(r.qid, r.docid): (r["rank"], round(r.score, 9)) for r in found.collect()}
        want = {(r.qid, r.docid): (r["rank"], round(r.score, 9)) for r in R.rank(index.scores(terms, "paragraph", body).select("qid", "docid", "score")).collect()}
        assert got == want and len(got) > 500


def test_packed_numbers_come_back():
    from lanternrank.operators.blocks import _packed, _unpacked

    for values in ([], [0], [3, 1 << 31, 7], [1 << 40, 0]):
        assert _unpacked(_packed(np.array(values, np.int64)), len(values)).tolist() == values
