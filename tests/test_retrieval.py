import json
import math
import uuid

import numpy as np
import pytest

from lanternrank.functions import stats
from lanternrank.functions import text as X
from lanternrank.operators import encoders as E
from lanternrank.operators import metrics as M
from lanternrank.operators import pooling as P
from lanternrank.operators import ranking as R
from lanternrank.operators import training as L
from lanternrank.plans import evaluate as V
from lanternrank.sources import corpus as C
from lanternrank.sources import indexes, workspace
from lanternrank.streaming import indexing
from pyspark.sql import functions as F


@pytest.fixture
def mini(tmp_path):
    files = {
        "2301.1.json": json.dumps({"paper_id": "2301.1", "title": "T1", "abstract": "A1", "paragraphs": {"2301.1_2": "b b", "2301.1_1": "a", "2301.1_10": "  "}}),
        "2301.2.json": json.dumps({"paper_id": "2301.2", "title": "T2", "paragraphs": {"2301.2_1": "a c"}}),
        "nop.json": json.dumps({"paper_id": "nop"}),
        "bad.json": "{bad",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_scans(spark, mini):
    papers = C.papers(spark, mini)
    assert {r.paper_id for r in papers.collect()} == {"2301.1", "2301.2"}
    assert C.passages(papers).count() == 4
    assert C.passages(papers, clean=True).count() == 3
    fronts = {r.docid: r.text for r in C.passages(papers, front=True).where("is_front").collect()}
    assert fronts == {"2301.1_0": "T1. A1", "2301.2_0": "T2. "}
    with pytest.raises(Exception):
        C.papers(spark, mini, strict=True).collect()


def test_topics_and_files(spark, tmp_path):
    forms = [[{"query_id": 3, "query": "a"}, {"id": "x", "question": "b"}], {"queries": [{"qid": 3, "text": "a"}, {"qid": "x", "query": "b"}]}, {"3": "a", "x": {"text": "b"}}]
    for k, form in enumerate(forms):
        (tmp_path / f"{k}.json").write_text(json.dumps(form))
        assert [tuple(r) for r in C.topics(spark, f"{tmp_path}/{k}.json").collect()] == [("3", "a"), ("x", "b")]
    assert C.topics(spark, f"{tmp_path}/0.json", 1).count() == 1
    (tmp_path / "q.tsv").write_text("1\t0\td1\t2\n1 0 d2 0\n\n1 0 d1 1\n")
    assert {tuple(r) for r in C.qrels(spark, f"{tmp_path}/q.tsv").collect()} == {("1", "d1", 1), ("1", "d2", 0)}
    runs = spark.createDataFrame([("r", "1", "d1", 1, 0.5), ("r", "1", "d2", 2, 0.25)], "run string, qid string, docid string, rank int, score double")
    C.write_run(runs, f"{tmp_path}/run")
    assert sorted(map(tuple, C.read_run(spark, f"{tmp_path}/run").collect())) == sorted(map(tuple, runs.collect()))


def test_ids_and_chunks(spark):
    row = spark.createDataFrame([("x_y_3", "noscore", "a_10", "a b c d e f g h i j", "")], "a string, b string, c string, t string, e string").select(
        X.paper_id_last(F.col("a")), X.paper_id_first(F.col("a")), X.paper_id_last(F.col("b")), X.is_front(F.col("c")), F.transform(X.chunks(X.tokens(F.col("t")), 4), F.size), X.chunks(X.tokens(F.col("e")), 4), X.sig3(F.lit(0.230200)), X.sig3(F.lit(0.0)),
    ).first()
    assert list(row) == ["x_y", "x", "noscore", False, [4, 4, 2], [], 0.23, 0.0]


def test_pooling(spark):
    w = spark.createDataFrame([("d", 0, 4, "a", 1.0), ("d", 0, 4, "b", 3.0), ("d", 1, 1, "b", 1.0), ("d", 1, 1, "c", 2.0)], "docid string, chunk int, n_tokens int, term string, weight double")
    assert {r.term: r.weight for r in E.max_pool(w).collect()} == {"a": 1, "b": 3, "c": 2}
    assert {r.term: round(r.weight, 9) for r in E.mean_pool(w).collect()} == {"a": 0.8, "b": 2.6, "c": 0.4}
    v = spark.createDataFrame([("p", [3.0, 0.0]), ("p", [0.0, 4.0]), ("z", [0.0, 0.0])], "paper_id string, vector array<double>")
    assert [(r.paper_id, [round(x, 6) for x in r.vector]) for r in P.mean_pool(v).collect()] == [("p", [0.6, 0.8])]
    body = spark.createDataFrame([("p", " same ", [1.0])], "paper_id string, text string, vector array<double>")
    heads = spark.createDataFrame([("p", "title", "t", [2.0]), ("p", "abstract", "same", [9.0])], "paper_id string, part string, text string, vector array<double>")
    assert sorted(r.vector[0] for r in P.with_heads(body, heads).collect()) == [1.0, 2.0]


@pytest.fixture
def judged(spark):
    qrels = spark.createDataFrame([("q1", "d1", 2), ("q1", "d2", 1), ("q1", "d3", 0), ("q1", "d9", 2), ("q2", "d4", 1), ("q3", "d5", 2)], "qid string, docid string, rel int")
    scores = spark.createDataFrame([("q1", "d2", 0.9), ("q1", "d1", 0.8), ("q1", "d7", 0.7), ("q1", "d9", 0.7), ("q1", "d3", 0.1), ("q2", "d8", 0.5), ("q2", "d4", 0.4), ("q4", "d1", 0.9)], "qid string, docid string, score double")
    return R.rank(scores).withColumn("run", F.lit("r")), qrels


def test_metrics(judged):
    runs, qrels = judged
    value = lambda level: {(r.qid, r.metric): round(r.value, 6) for r in M.per_query(runs, qrels, level).collect()}
    one, two = value(1), value(2)
    assert one["q1", "ndcg"] == 0.830231 and one["q2", "ndcg"] == 0.63093 and one["q3", "ndcg"] == 0
    assert one["q1", "mrr"] == 1 and two["q1", "mrr"] == 0.5 and one["q1", "p5"] == 0.6 and two["q1", "p5"] == 0.4
    assert {q for q, _ in one} == {"q1", "q2", "q3"}
    mean = {r.metric: round(r.value, 6) for r in M.means(M.per_query(runs, qrels)).collect()}
    assert (mean["ndcg"], mean["mrr"], mean["p5"]) == (0.487054, 0.5, 0.266667)
    with pytest.raises(ValueError):
        M.per_query(runs, qrels, 1, ("map",))


def test_comparison(spark):
    d = [0.1, 0.2, 0.0, -0.1, 0.3]
    rows = [("a", str(i), "m", 0.5 + x) for i, x in enumerate(d)] + [("b", str(i), "m", 0.5) for i in range(5)] + [("c", str(i), "m", 0.5) for i in range(5)]
    got = {(r.run_a, r.run_b): r for r in M.compared(spark.createDataFrame(rows, "run string, qid string, metric string, value double")).collect()}
    r = got["a", "b"]
    assert (r.wins, r.ties, r.losses, round(r.t, 6), r.df, round(r.p, 6), r.p_shown, r.better) == (3, 1, 1, 1.414214, 4, 0.2302, 0.23, None)
    assert got["b", "c"].p is None and got["b", "c"].better is None
    told = [(2.228139, 10, 0.05), (12.7062, 1, 0.05), (0.0, 3, 1.0), (-2.228139, 10, 0.05), (1e-9, 7, 1.0), (1.959964, 10**6, 0.05), (40.0, 30, 1.9e-27), (None, 4, None), (1.0, 0, None), (4.302653, 2, 0.05), (0.5, 2000, 0.61713)]
    got = [r.p for r in spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(told)], "i int, t double, df long").select("i", stats.p_value("t", "df").alias("p")).orderBy("i").collect()]
    assert all((p is None) == (w is None) and (p is None or abs(p - w) < 1e-6) for p, (_, _, w) in zip(got, told)) and 1e-27 < got[6] < 1e-25


def test_search_against_numpy(spark):
    rng = np.random.default_rng(1)
    q, d = rng.normal(size=(3, 8)), rng.normal(size=(40, 8))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vector array<double>")
    corpus = spark.createDataFrame([(f"p{i // 4}_{i}", f"p{i // 4}", v.tolist()) for i, v in enumerate(d)], "docid string, paper_id string, vector array<double>")
    top = R.rank(R.dense_scores(queries, corpus, k=5), k=5).orderBy("qid", "rank").collect()
    for i in range(3):
        assert [r.docid for r in top if r.qid == i] == [f"p{j // 4}_{j}" for j in np.argsort(-(d @ q[i]))[:5]]
    best = R.best_passage(R.dense_scores(queries, corpus, group="paper_id")).collect()
    assert all(abs(r.score - (d @ q[r.qid])[int(r.paper_id[1:]) * 4 :][:4].max()) < 1e-12 for r in best)
    assert R.dense_scores(queries.limit(0), corpus).count() == 0


def test_padding_and_rerank(spark):
    items = spark.createDataFrame([(x,) for x in "abcdef"], "docid string")
    queries = spark.createDataFrame([("1", "x y"), ("2", "z")], "qid string, query string")
    ranked = R.rank(spark.createDataFrame([("1", "d", 0.5), ("1", "b", 0.25)], "qid string, docid string, score double"), k=4)
    got = R.padded(ranked, queries, items, 4).orderBy("qid", "rank").collect()
    assert [(r.qid, r.docid, r.rank) for r in got] == [("1", "d", 1), ("1", "b", 2), ("1", "a", 3), ("1", "c", 4), ("2", "a", 1), ("2", "b", 2), ("2", "c", 3), ("2", "d", 4)]
    texts = spark.createDataFrame([("d", "y"), ("b", "x y")], "docid string, text string")
    assert [r.docid for r in R.rerank(ranked, queries, texts, R.overlap_scorer).orderBy("rank").collect()] == ["b", "d"]


def test_splits(spark):
    for f, sizes in ((L.split_80_20, {4: 2, 10: 2, 23: 4}), (L.split_90_10, {1: 0, 10: 1, 25: 3}), (L.split_eligible, {3: 1, 15: 2, 25: 2, 35: 4})):
        for n, want in sizes.items():
            rows = f(spark.range(n).toDF("qid")).collect()
            assert len(rows) == n and sum(r.is_validation for r in rows) == want


def test_losses(spark):
    pairs = spark.createDataFrame([(2.0, 1.0), (0.5, 1.5)], "pos_score double, neg_score double")
    assert round(L.pairwise_logistic(pairs).first()[0], 6) == 0.813262
    rows = [(1, 10.0, True), (1, 4.0, False), (1, 2.0, True), (2, 1.0, False), (2, 6.0, True), (2, 3.0, False)]
    assert [round(r.loss, 6) for r in L.infonce(spark.createDataFrame(rows, "qid int, score double, positive boolean")).orderBy("qid").collect()] == [0.002475, 0.054985]
    w = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0), ("c", 1.0)], "term string, weight double")
    assert L.flops(w, 2).first()[0] == 9.5
    h = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.3), ("m", 3, 0.3)], "model string, epoch int, val_loss double")
    assert tuple(L.best_epoch(h).first()) == ("m", 2, 3)


def test_pairs_are_drawn_from_the_grid(spark):
    """A query has all its pairs or the cap, each once, and over many queries every cell is drawn alike."""
    sizes = {q: (1 + q % 7, 1 + q // 7 % 23) for q in range(400)} | {1000: (400, 300), 1001: (1, 5000)}
    rows = [(q, f"{s}{i}", rel) for q, (p, n) in sizes.items() for s, rel, m in (("p", 2, p), ("n", 1, n)) for i in range(m)]
    pairs = [tuple(r) for r in L.training_pairs(spark.createDataFrame(rows, "qid long, docid string, rel int"), most=60).collect()]
    assert len(set(pairs)) == len(pairs)
    count = {q: sum(r[0] == q for r in pairs) for q in sizes}
    assert count == {q: min(60, p * n) for q, (p, n) in sizes.items()}
    rows = [(q, f"{s}{i}", rel) for q in range(500) for s, rel, m in (("p", 2, 5), ("n", 1, 8)) for i in range(m)]
    drawn = [r[1:] for r in map(tuple, L.training_pairs(spark.createDataFrame(rows, "qid long, docid string, rel int"), most=10).collect())]
    cells = np.array([drawn.count((f"p{i}", f"n{j}")) for i in range(5) for j in range(8)])
    assert cells.sum() == 5000 and ((cells - 125) ** 2 / 125).sum() < 80  # 39 degrees of freedom


def test_numbers_without_one_task(spark):
    from lanternrank.operators.numbering import numbered

    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("key"), F.col("id").alias("place_")).repartition(7)
    got = [(r.key, r.place, r.n) for r in numbered(rows, F.col("key").desc(), count="n").collect()]
    assert sorted(got, key=lambda r: r[1]) == [(k, i + 1, 5000) for i, k in enumerate(sorted((r[0] for r in got), reverse=True))]
    assert numbered(rows.limit(0), "key").count() == 0


def _read_files(df) -> int:
    """Files that the scan of a plan without exchanges has read."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numFiles").value()


def test_lookup_reads_few_files(spark, tmp_path):
    from lanternrank.sources import store

    rows = spark.range(20_000).select(F.concat(F.lit("p"), (F.col("id") / 10).cast("int").cast("string"), F.lit("_"), F.col("id").cast("string")).alias("docid"), F.md5(F.col("id").cast("string")).alias("text"))
    store.write_passages(rows, f"{tmp_path}/s", 32)
    whole = spark.read.parquet(f"{tmp_path}/s/passages")
    found = store.find(spark, f"{tmp_path}/s", ["p3_37", "p1999_19999", "p3_37", "none"])
    assert {r.docid: r.text for r in found.collect()} == {r.docid: r.text for r in rows.where("docid in ('p3_37', 'p1999_19999')").collect()}
    assert _read_files(found) <= 3 and _read_files(whole) >= 32
    many = [f"p{i // 10}_{i}" for i in range(0, 20_000, 7)]
    assert store.find(spark, f"{tmp_path}/s", many).count() == len(many)


def test_batches(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(11, 4))
    got = L.diverse_batches(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "qid long, vector array<double>")).collect()
    assert sorted(r.qid for r in got) == list(range(11)) and sorted(map(len, L.farthest_first(v, 4, 1))) == [3, 4, 4]
    rows = spark.createDataFrame([(i, "same" if i < 2 else f"d{i}") for i in range(10)], "qid int, docid string")
    assert L.usable(L.batches(rows)).count() <= 1
    batched = L.batches(rows, 3)
    want = [b for b in range(4) if len({r.docid for r in batched.collect() if r.batch == b}) == 3]
    assert want and [r.batch for r in L.usable(batched, size=3).orderBy("batch").collect()] == want


def test_reports(spark):
    new, old = (spark.createDataFrame(x, "method string, ms double") for x in ([("a", 1.0), ("c", 3.0)], [("a", 9.0), ("b", 2.0)]))
    assert dict(map(tuple, V.carried_forward(new, old).collect())) == {"a": 1, "b": 2, "c": 3}
    lat = spark.createDataFrame([("m", 1, 100.0), ("m", 2, 1.0), ("m", 3, 3.0), ("one", 1, 5.0)], "method string, qid int, ms double")
    assert list(map(tuple, V.steady_mean(lat).collect())) == [("m", 2.0)]
    with pytest.raises(ValueError):
        V.Settings(k=0)


def _paper(folder, i, text, **more):
    (folder / f"p{i}.json").write_text(json.dumps({"paper_id": f"p{i}", "title": "t", "abstract": "a", "paragraphs": {f"p{i}_1": text, f"p{i}_2": "second common"}} | more))


def _same_search(spark, index, source, tmp_path):
    """The index finds what one that was built from nothing finds, and holds what it holds."""
    new = indexes.build_sparse(indexing._texts(C.papers(spark, str(source))), str(tmp_path / uuid.uuid4().hex), "new")
    topics = spark.createDataFrame([("1", "common w2"), ("2", "changed t"), ("3", "w1 w3 second"), ("4", "none")], "qid string, query string")
    terms = E.term_weights(topics.withColumnRenamed("query", "text"), "qid")
    for level, strategy in (("paragraph", "maxp"), ("paper", "maxp"), ("paper", "pool")):
        got, want = (sorted(map(tuple, x.search(topics, terms, level, strategy, 5).collect())) for x in (index, new))
        assert got == want and got
    for level in indexes.LEVELS:
        index.check(level, papers=new.papers())
        for what in ("items", "postings"):
            got, want = (sorted(map(repr, getattr(x, what)(level).collect())) for x in (index, new))
            assert got == want


def test_index_resumes(spark, tmp_path):
    source, folder = tmp_path / "papers", str(tmp_path / "index")
    source.mkdir()
    assert indexing.build(spark, str(source), folder, "s", 2) is None
    for i in range(3):
        _paper(source, i, f"w{i} common")
    index = indexing.build(spark, str(source), folder, "s", 2)
    assert index.papers() == 3 and indexing.manifest(index).agg(F.sum("papers")).first()[0] == 3
    _paper(source, 3, "w3 common")
    index = indexing.build(spark, str(source), folder, "s", 2)
    assert indexing.complete(index, 4) and len(index.segments) == 3
    with pytest.raises(ValueError):
        indexing.build(spark, str(source), folder, "other", 2)
    with pytest.raises(ValueError):
        indexing.build(spark, str(source), folder, "s", 3)


def test_index_follows_changes(spark, tmp_path, monkeypatch):
    """Papers are added, changed, deleted and put back; each time search equals that of a new index."""
    source, folder = tmp_path / "papers", str(tmp_path / "index")
    source.mkdir()
    for i in range(6):
        _paper(source, i, f"w{i} common")
    index = indexing.refresh(spark, str(source), folder, "s")
    first = index.version
    assert indexing.refresh(spark, str(source), folder, "s").version == first  # nothing new, no commit
    _paper(source, 2, "changed w2 w2")
    _paper(source, 6, "added common common")
    (source / "p4.json").unlink()
    index = indexing.refresh(spark, str(source), folder, "s")
    assert (index.version, index.papers(), index.dead_papers, len(index.segments)) == (first + 1, 6, 2, 2)
    old = indexes.SparseIndex(spark, folder, version=first)
    assert old.papers() == 6 and old.items("paper").where("docid = 'p4'").count() == 1  # earlier commits stay readable
    _paper(source, 2, "w2 common")
    _paper(source, 4, "w4 common", title="other")
    (source / "p0.json").unlink()
    index = indexing.refresh(spark, str(source), folder, "s")
    assert index.dead_papers == 4 and index.papers() == 6
    (source / "p1.json").unlink()  # only deletions: no new segment
    index = indexing.refresh(spark, str(source), folder, "s")
    assert len(index.segments) == 3 and index.papers() == 5
    _same_search(spark, index, source, tmp_path)
    merged = indexes.merge_sparse(index)
    assert (len(merged.segments), merged.dead_papers, merged.papers(), merged.version) == (1, 0, 5, index.version + 1)
    _same_search(spark, merged, source, tmp_path)
    monkeypatch.setattr(indexes, "MOST_DEAD", 0)
    _paper(source, 3, "changed again")
    index = indexing.refresh(spark, str(source), folder, "s")
    assert len(index.segments) == 1 and index.dead_papers == 0 and index.postings("paper").where("term = 'again'").count() == 1


def test_lost_update_leaves_no_trace(spark, tmp_path, monkeypatch):
    source, folder = tmp_path / "papers", str(tmp_path / "index")
    source.mkdir()
    for i in range(3):
        _paper(source, i, f"w{i} common")
    indexing.build(spark, str(source), folder, "s", 2)
    _paper(source, 7, "w7 common")
    _paper(source, 1, "changed")

    def lost(*args):
        raise RuntimeError("lost")

    commit = indexes._commit
    monkeypatch.setattr(indexes, "_commit", lost)
    with pytest.raises(Exception, match="lost"):
        indexing.refresh(spark, str(source), folder, "s", 2)
    monkeypatch.setattr(indexes, "_commit", commit)
    assert indexing.open_index(spark, folder, "s", 2).papers() == 3
    index = indexing.refresh(spark, str(source), folder, "s", 2)
    assert index.papers() == 4 and indexing.build(spark, str(source), folder, "s", 2).version == index.version


def test_bounds_skip_and_lose_nothing(spark, tmp_path):
    """Search over blocks finds what scoring everything finds, ties included, and scores a part of the passages."""
    import random

    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.6)) % 3000}" for _ in range(60_000)]
    rows = [(f"p{i // 4}_{i % 4}", " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(9000)] + [(f"q{i}_1", "w1 w2 w5") for i in range(90)]
    index = indexes.build_sparse(spark.createDataFrame(rows, "docid string, text string").repartition(4), f"{tmp_path}/i", "s")
    topics = spark.createDataFrame([(str(i), " ".join(r.choice(words) for _ in range(r.randint(1, 9)))) for i in range(40)] + [("tie", "w1 w2 w5"), ("rare", "nothing"), ("empty", "")], "qid string, query string")
    terms = E.term_weights(topics.withColumnRenamed("query", "text"), "qid")
    index.met = indexes.B.Met(spark)
    for k in (1, 20):
        got = index.search(topics, terms, "paragraph", k=k)
        want = R.padded(R.rank(index.scores(terms, "paragraph", body=True), k=k), topics, index.items("paragraph").where("not is_front"), k)
        shown = lambda df, item: sorted((x.qid, x[item], round(x.score, 6), x["rank"]) for x in df.collect())
        assert shown(got, "docid") == shown(want, "docid")
        for strategy, scores in (("maxp", R.maxp(index.scores(terms, "paragraph"))), ("pool", index.scores(terms, "paper").drop("paper_id").withColumnRenamed("docid", "paper_id"))):
            want = R.padded(R.rank(scores, "paper_id", k=k), topics, index.items("paper"), k, "paper_id")
            assert shown(index.search(topics, terms, "paper", strategy, k), "paper_id") == shown(want, "paper_id")
    assert 0 < index.met.share < 0.7


def test_dense_blocks_skip_and_lose_nothing(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    v = centres[rng.integers(30, size=12000)] + 0.1 * rng.normal(size=(12000, 16))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).round(2)
    rows = [(f"p{i // 5}_{i % 5}", f"p{i // 5}", x.tolist()) for i, x in enumerate(v)] + [(f"s{i}_1", f"s{i}", v[0].tolist()) for i in range(70)]
    corpus = spark.createDataFrame(rows, "docid string, paper_id string, vector array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate([v[:25], rng.normal(size=(3, 16))]))], "qid long, vector array<double>")
    index = indexes.build_dense(corpus.repartition(4), f"{tmp_path}/d", "s")
    index.met = indexes.B.Met(spark)
    shown = lambda df, *c: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select("qid", *c, "score", "rank").collect())
    for k in (1, 50):
        assert shown(index.search(queries, "paragraph", k=k), "docid") == shown(R.rank(R.dense_scores(queries, corpus), k=k), "docid")
        want = R.rank(R.best_passage(R.dense_scores(queries, corpus, group="paper_id")), "paper_id", k=k)
        assert shown(index.search(queries, "paper", k=k), "paper_id", "docid") == shown(want, "paper_id", "docid")
    assert 0 < index.met.share < 0.6
    assert index.search(queries.limit(0), "paper").count() == 0


def test_paper_means_are_added_to(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 6))
    rows = [(f"p{i % 40}_{i}", f"p{i % 40}", x.tolist()) for i, x in enumerate(v)] + [("z_1", "z", v[0].tolist()), ("z_2", "z", (-v[0]).tolist())]
    every = spark.createDataFrame(rows, "docid string, paper_id string, vector array<double>")
    folder = f"{tmp_path}/d"
    for part in (every.where("docid like 'z%' or docid < 'p2'"), every.where("not (docid like 'z%' or docid < 'p2') and docid < 'p3'"), every.where("docid like 'p%' and docid >= 'p3'")):
        index = indexes.add_dense(part, folder, "s")
    assert len(index.parts) == 3 and index.counts["paragraph"] == 122
    index.check(papers=41)
    got, want = ({r.paper_id: [round(x, 9) for x in r.vector] for r in df.collect()} for df in (index.papers(), P.mean_pool(every)))
    assert got == want and "z" not in got
    q = spark.createDataFrame([(1, v[3].tolist())], "qid long, vector array<double>")
    shown = lambda df: [(r.paper_id, round(r.score, 9), r["rank"]) for r in df.orderBy("rank").collect()]
    assert shown(index.search(q, "paper", "mean", 7)) == shown(R.rank(R.dense_scores(q, P.mean_pool(every), "paper_id"), "paper_id", k=7))
    with pytest.raises(ValueError):
        indexes.add_dense(every, folder, "other")


def test_sparse_index(spark, tmp_path):
    rows = spark.createDataFrame([("p_0", "front words"), ("p_1", "a b b"), ("p_2", " "), ("r_1", "a c"), ("s_1", "d")], "docid string, text string")
    index = indexes.build_sparse(rows, f"{tmp_path}/i", "sig")
    index.check("paragraph", papers=3)
    assert index.counts == {"paragraph": (5, 7), "paper": (3, 7)}
    norms = {r.docid: round(r.norm, 9) for r in index.postings("paragraph").collect()}
    assert norms["p_1"] == round(math.hypot(math.log(2), math.log(3)), 9) and index.items("paragraph").where("docid = 'p_2'").count() == 1
    topics = spark.createDataFrame([("1", "a"), ("2", "none")], "qid string, query string")
    terms = E.term_weights(topics.withColumnRenamed("query", "text"), "qid")
    found = lambda level, strategy, k: [(r.qid, r[1], round(r.score, 6), r["rank"]) for r in index.search(topics, terms, level, strategy, k).orderBy("qid", "rank").collect()]
    a = round(math.log(2) / math.hypot(math.log(2), math.log(3)), 6)
    r = round(math.sqrt(0.5), 6)
    assert found("paragraph", "maxp", 3) == [("1", "r_1", r, 1), ("1", "p_1", a, 2), ("1", "p_2", 0, 3), ("2", "p_1", 0, 1), ("2", "p_2", 0, 2), ("2", "r_1", 0, 3)]
    assert found("paper", "maxp", 2) == [("1", "r", r, 1), ("1", "p", a, 2), ("2", "p", 0, 1), ("2", "r", 0, 2)]
    pooled = round(math.log(2) / math.sqrt(3 * math.log(2) ** 2 + math.log(3) ** 2), 6)
    assert found("paper", "pool", 3)[:3] == [("1", "r", r, 1), ("1", "p", pooled, 2), ("1", "s", 0, 3)]
    for wrong in (lambda: index.search(topics, terms, "chapter"), lambda: index.search(topics, terms, "paper", "sum"), lambda: indexes.SparseIndex(spark, f"{tmp_path}/i", "other"), lambda: index.check("paper", papers=4)):
        with pytest.raises(ValueError):
            wrong()
    rows.limit(1).withColumns({"paper_id": F.lit("x"), "is_front": F.lit(True)}).select("docid", "paper_id", "is_front").write.mode("append").parquet(f"{tmp_path}/i/items/level=paragraph/segment={index.segments[0]}")
    with pytest.raises(ValueError, match="manifest"):
        index.check("paragraph")
    assert index.size("paper").first().bytes > 0


def test_dense_index(spark, tmp_path):
    rows = spark.createDataFrame([("p_1", "p", [1.0, 0.0]), ("p_2", "p", [0.0, 1.0]), ("r_1", "r", [0.6, 0.8]), ("z", "z", [0.0, 0.0]), ("n", "n", None)], "docid string, paper_id string, vector array<double>")
    index = indexes.build_dense(rows, f"{tmp_path}/d", "sig")
    index.check()
    q = spark.createDataFrame([(1, [0.8, 0.6])], "qid long, vector array<double>")
    got = lambda level, *more: [(r[1], round(r.score, 6)) if level == "paragraph" or "docid" not in r.asDict() else (r.paper_id, round(r.score, 6)) for r in index.search(q, level, *more).orderBy("rank").collect()]
    assert got("paragraph") == [("r_1", 0.96), ("p_1", 0.8), ("p_2", 0.6)] and got("paper") == [("r", 0.96), ("p", 0.8)]
    assert got("paper", "mean") == [("p", round(1.4 / math.sqrt(2), 6)), ("r", 0.96)]
    texts = spark.createDataFrame([("p_1", "x"), ("p_2", "x y"), ("r_1", "z")], "docid string, text string")
    topics = spark.createDataFrame([(1, "x y")], "qid long, query string")
    assert [x[0] for x in got("paragraph", "crossencoder", 3, R.overlap_scorer, texts, topics)] == ["p_2", "p_1", "r_1"]
    assert [x[0] for x in got("paragraph", "crossencoder", 2, R.overlap_scorer, texts, topics)] == ["p_1", "r_1"]
    with pytest.raises(Exception, match="no text for r_1"):
        got("paragraph", "crossencoder", 3, R.overlap_scorer, texts.where("docid <> 'r_1'"), topics)
    for wrong in (("chapter",), ("paragraph", "mean"), ("paragraph", "crossencoder")):
        with pytest.raises(ValueError):
            index.search(q, *wrong)


def test_made_once(spark):
    calls, name = [], f"thing-{uuid.uuid4().hex}"  # the shared folder may outlive the session

    def make(path):
        calls.append(path)
        spark.range(1).write.parquet(path)
        if len(calls) == 1:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        workspace.made(spark, name, "abc", make)
    first = workspace.made(spark, name, "abc", make)
    assert workspace.made(spark, name, "abc", make) == first == calls[1]  # what a failed maker left is not used
    workspace._made.clear()
    assert workspace.made(spark, name, "abc", make) == first  # another process finds it too
    assert workspace.made(spark, name, "other", make) != first and workspace.made(spark, name, "abc", make, force=True) != first and len(calls) == 4


def test_evaluation(spark, judged, tmp_path):
    runs, qrels = judged
    scores = runs.select("qid", "docid", "score")
    topics = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c"), ("q4", " ")], "qid string, query string")
    search = lambda sign: lambda t, level, k: R.rank(scores.withColumn("score", F.col("score") * sign).join(t.select("qid"), "qid", "left_semi"), k=k)
    systems = [V.System("up", search(1), ("paragraph",), on_test=True, save="sparse"), V.System("down", search(-1), ("paragraph",), experimental=True, save="never")]
    sets = [V.QuerySet("study", topics, {"paragraph": qrels}), V.QuerySet("test", topics.where("qid = 'q1'"))]
    settings = V.Settings(levels=("paragraph",), k=5)
    out = V.run_evaluation(spark, systems, sets, settings, str(tmp_path / "e"))
    assert {(r.set, r.run) for r in out.runs.select("set", "run").distinct().collect()} == {("study", "up"), ("study", "down"), ("test", "up")}
    assert out.latency.where("ms > 0").count() == 4 + 4 + 1
    means = {(r.run, r.level, r.metric): round(r.value, 6) for r in out.reports["study", "paragraph"].means.collect()}
    assert (means["up", 1, "ndcg"], means["up", 1, "p5"], means["up", 2, "p5"]) == (0.487054, 0.266667, 0.133333) and ("up", 2, "ndcg") not in means
    pair = {(r.run_a, r.run_b) for r in out.reports["study", "paragraph"].comparisons.collect()}
    assert pair == {("up", "down")}  # in order of the systems, not of names
    text = {k[2]: json.loads(v.first().report) for k, v in out.texts.items()}
    assert text["summary"]["relevance_passes"]["relevant_or_partial"]["metrics"]["up"]["ndcg"] == pytest.approx(0.487054, abs=1e-6) and text["summary"]["k"] == 5
    assert list(text["summary"]["trec_runs"]) == ["up"] and text["summary"]["experimental_methods"] == ["down"]
    assert text["queries"]["relevance_passes"]["relevant_only"]["queries"]["q1"]["up"] == {"mrr": 0.5, "p5": 0.4}
    entry = text["significance"]["relevance_passes"]["relevant_or_partial"]["comparisons"]["up vs down"]["mrr"]
    assert set(entry) == {"p", "better", "win_tie_loss"} and set(entry["win_tie_loss"]) == {"W", "T", "L"} and entry["better"] is None
    assert C.read_run(spark, C.run_path(f"{tmp_path}/e/trec", "team", "paragraph", "sparse", "test")).count() == 5
    with pytest.raises(ValueError):
        V.run_evaluation(spark, systems, [V.QuerySet("study", topics, {"paper": qrels})], settings)
    with pytest.raises(ValueError):
        V.Settings(metrics=(), strict_metrics=())
    with pytest.raises(ValueError):
        V.Settings(levels=("chapter",))


def test_configured_systems(spark, tmp_path):
    """A configuration's systems search at their levels, a finished run stands beside them, each query has a time of its own, and a prior one is carried on."""
    rows = spark.createDataFrame([(f"p{i}_{j}", f"w{i} w{j} " * (1 + 40 * (i == 3))) for i in range(12) for j in range(1, 4)], "docid string, text string")
    vectors = rows.select("docid", X.paper_id_last(F.col("docid")).alias("paper_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.pmod(F.xxhash64("docid", k), F.lit(97)) + 1).cast("double")).alias("vector"))
    sparse, dense = indexes.build_sparse(rows, f"{tmp_path}/s", "s"), indexes.build_dense(vectors, f"{tmp_path}/d", "s")
    topics = spark.createDataFrame([("0", "nothing of it"), ("1", "w1"), ("2", " ".join(f"w{j}" for j in range(12)))], "qid string, query string")
    config = {"sets": [{"name": "study", "metrics": True}, {"name": "test", "metrics": False}], "models": {"a": {"save_id": "sparse", "do_test": True}, "b": {"type": "dense", "level": "paper", "paper_method": "mean_pooling"}, "c": {"type": "dense", "level": "paragraph", "paragraph_method": "crossencoder"}}}
    near = V.Model(dense, lambda t: t.select("qid", F.array(*[F.lit(0.5)] * 4).alias("vector")), scorer=R.overlap_scorer, texts=rows)
    models = {"a": V.Model(sparse, lambda t: E.term_weights(t.withColumnRenamed("query", "text"), "qid"), papers=12), "b": near, "c": near}
    systems = V.systems_of(config, models)
    assert [(s.name, s.levels, s.on_test, s.experimental) for s in systems] == [("a", ("paper", "paragraph"), True, False), ("a-pool", ("paper",), False, True), ("b", ("paper",), False, False), ("c", ("paragraph",), False, False)]
    C.write_run(spark.createDataFrame([("bm25", "0", "p1_1", 1, 2.0), ("bm25", "9", "p1_1", 1, 2.0)], "run string, qid string, docid string, rank int, score double"), f"{tmp_path}/bm25")
    systems.append(V.finished_run("bm25", C.read_run(spark, f"{tmp_path}/bm25"), "paragraph"))
    qrels = spark.createDataFrame([("0", "p1_1", 2), ("1", "p2_1", 1)], "qid string, docid string, rel int")
    sets = [V.QuerySet("study", topics, {"paragraph": qrels, "paper": qrels.withColumn("docid", X.paper_id_last(F.col("docid")))}), V.QuerySet("test", topics)]
    settings, _ = V.settings_of(config)
    out = V.run_evaluation(spark, systems, sets, settings, f"{tmp_path}/e")
    found = {(r.set, r.level, r.run) for r in out.runs.select("set", "level", "run").distinct().collect()}
    assert found == {("study", "paper", "a"), ("study", "paragraph", "a"), ("study", "paper", "a-pool"), ("study", "paper", "b"), ("study", "paragraph", "c"), ("test", "paper", "a"), ("test", "paragraph", "a"), ("study", "paragraph", "bm25"), ("test", "paragraph", "bm25")}
    assert out.runs.where("run = 'bm25'").count() == 2  # topics that aren't asked have no rows
    times = {(r.set, r.level, r.method, r.qid): (r.ms, r.cold_ms) for r in out.latency.collect()}
    one = [times["study", "paper", "a", q][0] for q in "012"]
    assert one[0] < one[1] and all(0 <= cold <= ms and ms > 0 for ms, cold in times.values()) and any(cold > 0 for _, cold in times.values())
    assert json.loads(out.texts["study", "paper", "summary"].first().report)["experimental_methods"] == ["a-pool"]
    again = V.run_evaluation(spark, systems[2:3], sets[:1], V.Settings(levels=("paper",)), f"{tmp_path}/f", prior=f"{tmp_path}/e")
    assert {r.method for r in again.latency.collect()} == {"a", "a-pool", "b", "c", "bm25"} and ("study", "paper", "significance") not in again.texts
    assert again.latency.where("method = 'a'").count() == out.latency.where("method = 'a'").count()
    incomplete = V.systems_of(config, models | {"a": V.Model(sparse, models["a"].encode, papers=13)})
    with pytest.raises(ValueError, match="incomplete index"):
        V.run_evaluation(spark, incomplete, sets, settings, f"{tmp_path}/g")
    for wrong in ({"b": {"type": "dense", "level": "paper", "paper_method": "cosine_similarity"}}, {"x": {}}):
        with pytest.raises(ValueError):
            V.systems_of(config | {"models": wrong}, models)


def test_limited_evaluation(spark, tmp_path):
    """The first topics of the file are searched, and judgments of the others don't count as zeros."""
    (tmp_path / "t.json").write_text(json.dumps([{"qid": q, "query": "x"} for q in ("30", "4", "100", "2")]))
    topics = C.topics(spark, f"{tmp_path}/t.json", ordinal=True)
    qrels = spark.createDataFrame([(q, f"d{q}", 2) for q in ("30", "4", "100", "2")], "qid string, docid string, rel int")
    search = lambda t, level, k: t.select("qid", F.concat(F.lit("d"), "qid").alias("docid"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    out = V.run_evaluation(spark, [V.System("s", search, ("paragraph",))], [V.QuerySet("study", topics, {"paragraph": qrels})], V.Settings(levels=("paragraph",), limit=2), str(tmp_path / "e"))
    assert {r.qid for r in out.runs.collect()} == {"30", "4"} == {r.qid for r in out.latency.collect()}
    assert {r.value for r in out.reports["study", "paragraph"].means.where("metric = 'mrr'").collect()} == {1.0}
    with pytest.raises(ValueError):
        V.Settings(limit=0)


def test_significance_of_twelve_queries(spark):
    """Wins, ties and losses are the first run's, p has three digits, and without significance no run is better."""
    rows = [(run, str(i), "ndcg", 1, v) for i, d in enumerate([0.2] * 6 + [0.0] * 5 + [-0.01]) for run, v in (("bm25", 0.5 + d), ("tfidf", 0.5))]
    values = spark.createDataFrame(rows, "run string, qid string, metric string, level int, value double")
    report = C.significance_report(M.compared(values, ("level", "metric"), order=("bm25", "tfidf")), {"set": "study"})
    got = json.loads(report.first().report)["relevance_passes"]["relevant_or_partial"]["comparisons"]["bm25 vs tfidf"]["ndcg"]
    assert got["better"] == "bm25" and got["win_tie_loss"] == {"W": 6, "T": 5, "L": 1} and 0 < got["p"] < 0.05 and len(f"{got['p']:.3g}") == len(str(got["p"]))


def test_significance_read_back(spark, tmp_path):
    """A written report gives the same comparisons; null p and better stay null, and a report without pairs has no rows."""
    values = spark.createDataFrame([(run, str(i), "mrr", level, v) for level in (1, 2) for i in range(9) for run, v in (("a", 0.1 * i), ("b", 0.1 * i), ("c", 0.1 * i - 0.3 - 0.01 * (i % 2)))], "run string, qid string, metric string, level int, value double")
    found = M.compared(values, ("level", "metric"))
    C.write_report(C.significance_report(found, {"set": "s"}), f"{tmp_path}/r")
    names = ["level", "run_a", "run_b", "metric", "p", "better", "wins", "ties", "losses"]
    got = C.read_significance(spark, f"{tmp_path}/r")
    assert {tuple(r) for r in got.select(*names).collect()} == {tuple(r) for r in found.drop("p").withColumnRenamed("p_shown", "p").select(*names).collect()}
    assert got.where("run_b = 'b' and p is null and better is null and ties = 9").count() == 2 and got.where("better = 'a' and run_b = 'c'").count() == 2
    C.write_report(C.significance_report(found.limit(0), {"set": "s"}), f"{tmp_path}/none")
    assert C.read_significance(spark, f"{tmp_path}/none").count() == 0


def test_content_signature(spark):
    """Order and cuts don't matter; a changed, repeated, missing or moved value and other settings do."""
    rows = [(1, "a"), (2, None), (3, "b" * 1000), (3, "")]
    sign = lambda r, **s: C.content_signature(spark.createDataFrame(r, "doc_id long, text string").repartition(len(r) or 1), ["doc_id", "text"], s).first().signature
    base = sign(rows, k=1)
    assert base == sign(rows[::-1], k=1)
    others = [sign(rows, k=2), sign(rows[1:], k=1), sign([*rows, rows[0]], k=1), sign([(1, "b"), *rows[1:]], k=1), sign([(2, "a"), (1, None), *rows[2:]], k=1), sign([], k=1)]
    assert len({base, *others}) == 7


def test_files(spark, mini, tmp_path, judged):
    assert {(r.file, r.reason) for r in C.skipped(spark, mini).collect()} == {("nop.json", "no paragraphs"), ("bad.json", "unreadable")}
    C.write_papers(C.papers(spark, mini), f"{tmp_path}/lines")
    again = C.papers(spark, f"{tmp_path}/lines", lines=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, C.papers(spark, mini).collect()))
    _, qrels = judged
    C.write_qrels(qrels, f"{tmp_path}/qrels")
    for tabs in (True, False):
        assert sorted(map(tuple, C.qrels(spark, f"{tmp_path}/qrels", tabs_only=tabs).collect())) == sorted(map(tuple, qrels.collect()))
    topics = spark.createDataFrame([("q1", "a"), ("q2", " ")], "qid string, query string")
    assert {r.qid for r in C.asked(qrels, topics).collect()} == {"q1"}
    assert C.qrel_path("d", "study", "paper") == "d/Study_paper_qrel.tsv"
    assert C.run_path("d", "t", "paper", "bm25", "study", stem=False) == "d/t_paper_bm25_study_no-stem.tsv" and C.run_path("d", "t", "paper", "dense", "study", stem=False) == "d/t_paper_dense_study.tsv"
    (tmp_path / "h.json").write_text('{"model": "m", "epoch": 1, "train_loss": 0.5, "validation_loss": 0.25}')
    assert tuple(C.read_history(spark, f"{tmp_path}/h.json").first()) == ("m", 1, 0.5, 0.25)
    with pytest.raises(Exception, match="four ids"):
        L.split_80_20(spark.range(3).toDF("qid")).collect()


def test_settings_and_summaries(spark, tmp_path):
    config = {"team_name": "t", "sets": [{"name": "study", "metrics": True}, {"name": "test", "metrics": False}], "levels": ["paper"], "k": 7, "models": {"a": {"type": "dense", "level": "paper"}, "b": None}}
    settings, sets = V.settings_of(config)
    assert (settings.k, settings.levels, settings.team, sets) == (7, ("paper",), "t", [("study", True), ("test", False)])
    for wrong in ({"models": {}}, {"sets": []}, {"models": {"a": {"type": "other"}}}, {"models": {"a": {"type": "dense", "level": "paragraph"}}}, {"k": 0}, {"levels": ["chapter"]}):
        with pytest.raises(ValueError):
            V.settings_of(config | wrong)
    means = spark.createDataFrame([("a", 1, "mrr", 0.5), ("a", 2, "mrr", 0.25), ("b", 1, "mrr", 1.0)], "run string, level int, metric string, value double")
    C.write_report(C.summary_report(means, {"set": "s", "level": "paper"}), f"{tmp_path}/summary")
    assert {(r.set, r.level_name, r.run, r.level, r.metric, r.value) for r in C.read_summary(spark, f"{tmp_path}/summary").collect()} == {("s", "paper", *r) for r in means.collect()}


def test_lookup(spark, mini):
    papers = C.papers(spark, mini)
    assert {tuple(r) for r in C.lookup(papers, ["2301.1_2", "2301.2_1", "2301.2_9", "none"]).collect()} == {("2301.1_2", "b b"), ("2301.2_1", "a c")}


def test_encoded_rows(spark):
    """Ten attempts, of 2 to 11 parts, by words; a text that never fits is null, and a model is loaded once a task."""

    def load():
        def encode(texts):
            if any(len(t.split()) > 3 for t in texts):
                raise MemoryError
            return [[float(len(t.split())), 1.0] for t in texts]

        return encode

    rows = spark.createDataFrame([(1, "a b"), (2, " ".join("x" * 33)), (3, " ".join("x" * 34)), (4, None), (5, " ".join("x" * 7))], "id int, text string").withColumn("vector", F.lit("clash"))
    got = {r.id: r.vector for r in E.encoded(rows, load).collect()}
    assert got[1] == [2.0, 1.0] and got[4] == [0.0, 1.0] and got[3] is None
    assert [round(x, 6) for x in got[2]] == [round(x / math.sqrt(10), 6) for x in (3, 1)]
    assert [round(x, 6) for x in got[5]] == [round(x / math.hypot(7 / 3, 1), 6) for x in (7 / 3, 1)]


def test_encoding_builds_the_index(spark, tmp_path):
    """Texts become vectors of an index; what fails in every way is told with its error, and a later build adds to the index."""

    def load():
        inner = E.hashed_loader(8)()

        def encode(texts):
            if any("Z" in t for t in texts):
                raise MemoryError("too long")
            return inner(texts)

        return encode

    rows = spark.createDataFrame([("p_1", "a b c"), ("p_2", "Z" * 40), ("q_1", ""), ("q_2", None), ("q_3", "b b")], "docid string, text string")
    index = indexes.encode_dense(rows, f"{tmp_path}/d", "s", load, batch=2)
    assert {tuple(r) for r in index.dropped().collect()} == {("p_2", "MemoryError: too long"), ("q_1", "zero vector"), ("q_2", "zero vector")}
    want = {r.docid: [round(x, 9) for x in r.vector] for r in E.hashed(rows.where("docid in ('p_1', 'q_3')"), 8).collect()}
    assert {r.docid: [round(x, 9) for x in r.vector] for r in index.vectors().collect()} == want
    index = indexes.encode_dense(spark.createDataFrame([("q_4", "c")], "docid string, text string"), f"{tmp_path}/d", "s", load)
    assert index.counts["paragraph"] == 3 and index.papers().count() == 2


def test_encode_fallback():
    import pandas as pd

    def encode(texts):
        if len(texts) > 1 and any(len(t) > 4 for t in texts) or any(len(t) > 4 for t in texts):
            raise MemoryError
        return [[float(len(t)), 1.0] for t in texts]

    got = list(E.encode_batches(iter([pd.Series(["ab", "abcdefgh"])]), encode))[0]
    assert got[0] == [2.0, 1.0] and abs(math.hypot(*got[1]) - 1) < 1e-9
