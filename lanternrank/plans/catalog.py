"""Every operator as a query over the tables, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternrank.functions import text as X
from lanternrank.functions.vectors import l2_normalize, rounded
from lanternrank.operators import encoders as E
from lanternrank.operators import metrics as M
from lanternrank.operators import pooling as P
from lanternrank.operators import ranking as R
from lanternrank.operators import training as L
from lanternrank.operators.numbering import numbered
from lanternrank.plans import evaluate as V
from lanternrank.plans.bindings import Tables
from lanternrank.sources import corpus as C
from lanternrank.sources import store as S
from lanternrank.sources import workspace

BUDGET = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the SQL texts; unused ones cost nothing.
WITH = r"""
WITH lines AS (
  SELECT doc_id::VARCHAR AS paper_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), passages AS (
  SELECT paper_id, paper_id || '_' || pos AS docid, pos::INTEGER AS pos, pos = 0 AS is_front, text FROM lines WHERE length(trim(text, ' ')) > 0
), topics AS (SELECT item_id::VARCHAR AS qid, text AS query FROM benchmark),
toks AS (SELECT paper_id, docid, is_front, list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '') AS t FROM passages),
topic_toks AS (SELECT qid, query, list_filter(string_split_regex(lower(query), '\s+'), lambda t: t <> '') AS t FROM topics),
postings AS (SELECT paper_id, docid, is_front, term, ln(1 + count(*)) AS weight FROM (SELECT paper_id, docid, is_front, unnest(t) AS term FROM toks) GROUP BY ALL),
topic_terms AS (SELECT qid, term, ln(1 + count(*)) AS weight FROM (SELECT qid, unnest(t) AS term FROM topic_toks) GROUP BY ALL),
topic_norms AS (SELECT qid, greatest(sqrt(sum(weight * weight)), 1e-12) AS norm FROM topic_terms GROUP BY qid),
doc_norms AS (SELECT docid, sqrt(sum(weight * weight)) AS norm FROM postings GROUP BY docid),
dots AS (SELECT q.qid, p.docid, p.paper_id, p.is_front, sum(q.weight * p.weight) AS dot FROM postings p JOIN topic_terms q USING (term) GROUP BY ALL),
sparse AS (SELECT d.qid, d.docid, d.paper_id, d.is_front, d.dot / greatest(n.norm, 1e-12) / t.norm AS score FROM dots d JOIN doc_norms n USING (docid) JOIN topic_norms t USING (qid)),
sparse_body AS (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docid) AS rank FROM sparse WHERE NOT is_front),
paper_postings AS (SELECT paper_id, term, max(weight) AS weight FROM postings GROUP BY ALL),
vecs AS (SELECT vec_id, (vec_id // 5)::VARCHAR AS paper_id, (vec_id // 5)::VARCHAR || '_' || (vec_id % 5) AS docid, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 25 <> 0),
queries AS (SELECT vec_id AS qid, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 25 = 0),
qrels AS (SELECT q.qid, d.docid, CASE WHEN d.vec_id % 2 = 0 THEN 2 ELSE 1 END AS rel FROM vecs d JOIN queries q USING (label)),
dense AS (SELECT q.qid, d.docid, d.paper_id, list_dot_product(q.v, d.v) AS score FROM queries q, vecs d),
full_run AS (SELECT * FROM (SELECT 'full' AS run, qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docid) AS rank FROM dense) WHERE rank <= 100),
half_run AS (SELECT * FROM (SELECT 'half' AS run, qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docid) AS rank FROM (SELECT q.qid, d.docid, list_dot_product(q.v[1:32], d.v[1:32]) AS score FROM queries q, vecs d)) WHERE rank <= 100),
runs AS (SELECT * FROM full_run UNION ALL SELECT * FROM half_run),
judged AS (SELECT r.*, coalesce(j.rel, 0) AS rel FROM runs r LEFT JOIN qrels j USING (qid, docid) WHERE r.qid IN (SELECT qid FROM qrels)),
levels AS (SELECT unnest([1, 2]) AS level),
ideals AS (
  SELECT level, qid, sum(rel / log2(place + 1)) AS best, sum(CASE WHEN place <= 5 THEN rel / log2(place + 1) ELSE 0 END) AS best5
  FROM (SELECT level, qid, g AS rel, row_number() OVER (PARTITION BY level, qid ORDER BY g DESC, docid) AS place FROM (SELECT level, qid, docid, CASE WHEN rel >= level THEN rel ELSE 0 END AS g FROM qrels, levels)) GROUP BY ALL
), sums AS (
  SELECT level, run, qid, sum(g / log2(rank + 1)) AS dcg, sum(CASE WHEN rank <= 5 THEN g / log2(rank + 1) ELSE 0 END) AS dcg5, coalesce(1 / min(CASE WHEN g > 0 THEN rank END), 0) AS mrr,
    sum(CASE WHEN g > 0 AND rank <= 5 THEN 1 ELSE 0 END) / 5 AS p5, sum(CASE WHEN g > 0 AND rank <= 10 THEN 1 ELSE 0 END) / 10 AS p10
  FROM (SELECT level, run, qid, rank, CASE WHEN rel >= level THEN rel ELSE 0 END AS g FROM judged, levels) GROUP BY ALL
), wide AS (
  SELECT i.level, r.run, i.qid, CASE WHEN best > 0 THEN coalesce(dcg, 0) / best ELSE 0 END AS ndcg, CASE WHEN best5 > 0 THEN coalesce(dcg5, 0) / best5 ELSE 0 END AS ndcg5, coalesce(mrr, 0) AS mrr, coalesce(p5, 0) AS p5, coalesce(p10, 0) AS p10
  FROM ideals i CROSS JOIN (SELECT DISTINCT run FROM runs) r LEFT JOIN sums s ON s.level = i.level AND s.run = r.run AND s.qid = i.qid
), vals AS (UNPIVOT wide ON ndcg, ndcg5, mrr, p5, p10 INTO NAME metric VALUE value),
diffs AS (SELECT a.level, a.metric, a.qid, a.run AS run_a, b.run AS run_b, a.value AS a, b.value AS b, round(a.value - b.value, 12) AS d FROM vals a JOIN vals b ON a.level = b.level AND a.metric = b.metric AND a.qid = b.qid AND a.run < b.run),
tests AS (
  SELECT level, metric, run_a, run_b, avg(a) AS mean_a, avg(b) AS mean_b, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END)::BIGINT AS wins, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END)::BIGINT AS ties, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END)::BIGINT AS losses,
    CASE WHEN count(*) > 1 AND stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t, count(*) - 1 AS df FROM diffs GROUP BY ALL
), positives AS (SELECT * FROM qrels WHERE rel > 0),
picks AS (SELECT qid, arg_min(docid, md5('42|0|' || docid) || docid) AS drawn, min(docid) AS first FROM positives GROUP BY qid),
batched AS (SELECT qid, drawn AS docid, ((row_number() OVER (ORDER BY md5('42|' || qid), qid) - 1) // 8)::INTEGER AS batch FROM picks),
cands AS (
  SELECT a.qid, a.docid = b.docid AS own, b.docid, list_dot_product(q.v, d.v) / 0.05 AS s, j.rel IS NOT NULL AS positive
  FROM batched a JOIN (SELECT DISTINCT batch, docid FROM batched) b ON a.batch = b.batch JOIN queries q ON q.qid = a.qid JOIN vecs d ON d.docid = b.docid LEFT JOIN qrels j ON j.qid = a.qid AND j.docid = b.docid
), poss AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY docid) - 1 AS at FROM qrels WHERE rel >= 2),
negs AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY docid) - 1 AS at FROM qrels WHERE rel = 1),
grid AS (SELECT qid, p, n, unnest(range(least(100, p * n))) AS cell FROM (SELECT qid, count(*) AS p FROM poss GROUP BY qid) JOIN (SELECT qid, count(*) AS n FROM negs GROUP BY qid) USING (qid)),
turn1 AS (SELECT qid, p, n, (cell // n + ('0x' || substr(md5('42|' || qid || '|1|' || cell % n), 1, 15))::BIGINT % p) % p AS i, cell % n AS j FROM grid),
turn2 AS (SELECT qid, p, n, i, (j + ('0x' || substr(md5('42|' || qid || '|2|' || i), 1, 15))::BIGINT % n) % n AS j FROM turn1),
turn3 AS (SELECT qid, p, n, (i + ('0x' || substr(md5('42|' || qid || '|3|' || j), 1, 15))::BIGINT % p) % p AS i, j FROM turn2),
turn4 AS (SELECT qid, i, (j + ('0x' || substr(md5('42|' || qid || '|4|' || i), 1, 15))::BIGINT % n) % n AS j FROM turn3),
pairs AS (
  SELECT t.qid, p.docid AS pos, n.docid AS neg FROM turn4 t JOIN poss p ON p.qid = t.qid AND p.at = t.i JOIN negs n ON n.qid = t.qid AND n.at = t.j
), chunked AS (SELECT docid, c AS chunk, len(k) AS n_tokens, unnest(k) AS term FROM (SELECT docid, c, t[c * 64 + 1:c * 64 + 64] AS k FROM (SELECT docid, t, unnest(range(0, (len(t) + 63) // 64)) AS c FROM toks))),
chunk_weights AS (SELECT docid, chunk, n_tokens, term, ln(1 + count(*)) AS weight FROM chunked GROUP BY ALL),
paper_means AS (
  SELECT paper_id, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS v
  FROM (SELECT paper_id, list(x ORDER BY pos) AS m FROM (SELECT paper_id, pos, avg(x) AS x FROM (SELECT paper_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vecs) GROUP BY ALL) GROUP BY paper_id) WHERE sqrt(list_dot_product(m, m)) > 0
)
"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = WITH + sql
        return f

    return add


def r6(c: str, name: str | None = None):
    return rounded(F.col(c)).alias(name or c)


# ---- scans and text

@query("scan_papers", "SELECT doc_id::VARCHAR AS paper_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0))::INTEGER AS n_passages FROM documents")
def _(t):
    return t.papers().select("paper_id", F.size("paragraphs").alias("n_passages"))


@query("explode_passages", "SELECT paper_id, docid, pos, text FROM passages")
def _(t):
    return C.passages(t.papers()).select("paper_id", "docid", F.substring_index("docid", "_", -1).cast("int").alias("pos"), "text")


@query("clean_passages", r"SELECT * FROM (SELECT docid, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM passages) WHERE text <> ''")
def _(t):
    return C.passages(t.papers(), clean=True).select("docid", "text")


@query("lookup_passage", "SELECT docid, text FROM passages WHERE docid IN ('1_1', '7_0', '42_2')")
def _(t):
    return S.find(t.spark, t.passage_store(), ["1_1", "7_0", "42_2"])


@query("topics_limit", "SELECT qid, query FROM (SELECT *, row_number() OVER (ORDER BY qid::BIGINT) AS n FROM topics) WHERE n <= 10")
def _(t):
    return C.topics(t.spark, t.topic_file(), limit=10)


@query("qrels_positive", "SELECT qid, docid, rel FROM qrels WHERE rel > 0 AND qid IN (SELECT qid FROM queries)")
def _(t):
    found = C.asked(C.qrels(t.spark, t.qrel_file(), positive_only=True), t.query_texts().withColumn("qid", F.col("qid").cast("string")))
    return found.withColumn("qid", F.col("qid").cast("long"))


@query("qrels_semi", "SELECT qid, docid, rel FROM qrels WHERE qid IN (SELECT qid FROM queries WHERE qid % 50 = 0)")
def _(t):
    blank = t.query_texts().withColumn("query", F.when(F.col("qid") % 50 == 0, F.col("query")).otherwise(" "))
    found = C.asked(C.qrels(t.spark, t.qrel_file(), tabs_only=True), blank.withColumn("qid", F.col("qid").cast("string")))
    return found.withColumn("qid", F.col("qid").cast("long"))


@query("missing_docs", "SELECT DISTINCT docid FROM qrels WHERE docid NOT IN (SELECT docid FROM vecs WHERE vec_id % 3 = 0)")
def _(t):
    return L.missing_docs(t.qrels(), t.vectors().where("vec_id % 3 = 0"))


@query("dense_scan", "SELECT docid, paper_id, len(v)::INTEGER AS dims FROM vecs")
def _(t):
    return t.dense().vectors().select("docid", "paper_id", F.size("vector").alias("dims"))


@query("front_passage", "SELECT doc_id::VARCHAR || '_0' AS docid, coalesce(source, '') || '. ' || coalesce(lang, '') AS text FROM documents")
def _(t):
    return t.table("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("docid"), X.front_text(F.col("source"), F.col("lang")).alias("text"))


@query("all_passages", "SELECT docid, text FROM passages WHERE NOT is_front UNION ALL SELECT doc_id::VARCHAR || '_0', coalesce(source, '') || '. ' || coalesce(lang, '') FROM documents")
def _(t):
    every = C.passages(t.papers(), front=True)
    return every.where(F.col("is_front") | ~X.is_front(F.col("docid"))).select("docid", "text")


@query("paper_id_last", "SELECT docid, regexp_replace(docid, '_[^_]*$', '') AS paper_id FROM (SELECT 'a_' || docid AS docid FROM passages)")
def _(t):
    return t.passages().select(F.concat(F.lit("a_"), "docid").alias("docid")).select("docid", X.paper_id_last(F.col("docid")).alias("paper_id"))


@query("paper_id_first", "SELECT docid, split_part(docid, '_', 1) AS paper_id FROM passages")
def _(t):
    return t.passages().select("docid", X.paper_id_first(F.col("docid")).alias("paper_id"))


@query("instruct_query", "SELECT qid, 'Instruct: Given a scientific research question, retrieve paragraphs from scientific papers that are relevant to answering the question.' || chr(10) || 'Query: ' || query AS query FROM topics")
def _(t):
    return t.topics().select("qid", X.instruct(F.col("query")).alias("query"))


@query("paragraph_filter", "SELECT docid FROM passages WHERE NOT regexp_matches(docid, '_0$')")
def _(t):
    return t.passages().select("docid").where(~X.is_front(F.col("docid")))


@query("checkpoint_order", "SELECT name, regexp_extract(name, 'checkpoint-([0-9]+)', 1)::BIGINT AS step, row_number() OVER (ORDER BY regexp_extract(name, 'checkpoint-([0-9]+)', 1)::BIGINT) AS place FROM (SELECT 'checkpoint-' || (n_nationkey * 7 % 25) * 100 AS name FROM nation)")
def _(t):
    name = F.concat(F.lit("checkpoint-"), ((F.col("n_nationkey") * 7 % 25) * 100).cast("string"))
    step = F.regexp_extract("name", "checkpoint-([0-9]+)", 1).cast("long")
    return t.table("nation").select(name.alias("name")).withColumn("step", step).withColumn("place", F.row_number().over(Window.orderBy("step")).cast("long"))


@query("sig3", "SELECT c_custkey, CASE WHEN p = 0 THEN 0.0 ELSE round(p * pow(10.0, 2 - floor(log10(abs(p))))) / pow(10.0, 2 - floor(log10(abs(p)))) END AS shown FROM (SELECT c_custkey, (c_custkey % 977) / 977 AS p FROM customer)")
def _(t):
    return t.table("customer").select("c_custkey", X.sig3((F.col("c_custkey") % 977) / F.lit(977)).alias("shown"))


@query("corpus_signature")
def _(t):
    return C.signature(C.files_of(t.spark, f"{t.dir}/documents.parquet"), {"tokens": 256, "interval": 100})


@query("corpus_content", """SELECT sha256('{"interval": 100, "tokens": 256}|' || count(*)::VARCHAR || '|' || coalesce(sum(h), 0)::VARCHAR) AS signature FROM (
  SELECT ('0x' || left(sha256(strlen(i)::VARCHAR || ':' || i || strlen(t)::VARCHAR || ':' || t), 15))::BIGINT AS h
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS i, coalesce(text, '') AS t FROM documents))""")
def _(t):
    return C.content_signature(t.table("documents"), ["doc_id", "text"], {"tokens": 256, "interval": 100})


# ---- chunks and encoders

@query("chunk_tokens", "SELECT docid, c::INTEGER AS chunk, len(k)::INTEGER AS n_tokens, array_to_string(k, ' ') AS text FROM (SELECT docid, c, t[c * 64 + 1:c * 64 + 64] AS k FROM (SELECT docid, t, unnest(range(0, (len(t) + 63) // 64)) AS c FROM toks))")
def _(t):
    parts = t.passages().select("docid", F.posexplode(X.chunks(X.tokens(F.col("text")), BUDGET)).alias("chunk", "toks"))
    return parts.select("docid", "chunk", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("text"))


@query("chunk_max_pool", "SELECT docid, term, round(max(weight), 6) AS weight FROM chunk_weights GROUP BY ALL")
def _(t):
    return E.max_pool(E.chunk_weights(t.passages(), BUDGET)).select("docid", "term", r6("weight"))


@query("chunk_mean_pool", "SELECT w.docid, term, round(sum(weight * n_tokens) / any_value(total), 6) AS weight FROM chunk_weights w JOIN (SELECT docid, len(t) AS total FROM toks) s ON s.docid = w.docid GROUP BY ALL")
def _(t):
    return E.chunk_means(t.passages(), BUDGET).select("docid", "term", r6("weight"))


@query("zero_vector_docs", "SELECT l.paper_id || '_' || l.pos AS docid, coalesce(round(n.norm, 6), 0) AS norm FROM lines l LEFT JOIN doc_norms n ON n.docid = l.paper_id || '_' || l.pos")
def _(t):
    lines = t.table("documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    items = lines.select(F.concat_ws("_", "paper_id", F.col("pos").cast("string")).alias("docid"))
    return items.join(R.norms(E.term_weights(t.passages())), "docid", "left").select("docid", F.coalesce(F.round("norm", 6), F.lit(0.0)).alias("norm"))


@query("sparse_norms", "SELECT docid, round(norm, 6) AS norm FROM doc_norms")
def _(t):
    return R.norms(E.term_weights(t.passages())).select("docid", r6("norm"))


@query("paper_max_pool", "SELECT paper_id, term, round(weight, 6) AS weight FROM paper_postings")
def _(t):
    return P.paper_max_pool(_postings(t)).select("paper_id", "term", r6("weight"))


FILLED = """
, hashes AS (SELECT docid, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS place, sum(weight) AS w FROM postings GROUP BY ALL),
filled AS (SELECT docid, list(coalesce(w, 0) ORDER BY i) AS m FROM (SELECT d.docid, i, w FROM (SELECT DISTINCT docid FROM hashes) d CROSS JOIN range(64) r(i) LEFT JOIN hashes s ON s.docid = d.docid AND s.place = i) GROUP BY docid)
SELECT docid, list_transform(m, lambda x: round(x / greatest(sqrt(list_dot_product(m, m)), 1e-12), 6)) AS unit FROM filled"""


@query("dense_from_texts", FILLED)
def _(t):
    return t.encoded_index().vectors().select("docid", F.transform("vector", lambda x: rounded(x)).alias("unit"))


@query("dense_dropped", r"SELECT docid, 'zero vector' AS reason FROM toks WHERE len(t) = 0")
def _(t):
    return t.encoded_index().dropped()


@query("dense_encode", FILLED)
def _(t):
    return E.hashed(t.passages()).select("docid", F.transform("vector", lambda x: rounded(x)).alias("unit"))


@query("last_token_pool", """
, states AS (SELECT vec_id, (embedding::DOUBLE[])[(vec_id % 4) * 16 + 1:(vec_id % 4) * 16 + 16] AS s FROM embeddings)
SELECT vec_id, list_transform(s, lambda x: round(x / greatest(sqrt(list_dot_product(s, s)), 1e-12), 6)) AS unit FROM states""")
def _(t):
    states = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    pooled = P.last_token(states, (F.col("vec_id") % 4 + 1).cast("int"))
    return t.table("embeddings").select("vec_id", F.transform(pooled, lambda x: rounded(x)).alias("unit"))


@query("l2_normalize", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 6)) AS unit FROM embeddings")
def _(t):
    return t.table("embeddings").select("vec_id", F.transform(l2_normalize(F.col("embedding")), lambda x: rounded(x)).alias("unit"))


HEADS = """
, parts AS (SELECT paper_id, v, label::VARCHAR AS text, CASE vec_id % 5 WHEN 3 THEN 'title' WHEN 4 THEN 'abstract' ELSE 'paragraph' END AS part FROM vecs),
kept AS (SELECT paper_id, v FROM parts p WHERE part <> 'abstract' OR NOT EXISTS (FROM parts q WHERE q.paper_id = p.paper_id AND q.part = 'paragraph' AND q.text = p.text)),
means AS (SELECT paper_id, list(x ORDER BY pos) AS m FROM (SELECT paper_id, pos, avg(x) AS x FROM (SELECT paper_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM kept) GROUP BY ALL) GROUP BY paper_id)
SELECT paper_id, list_transform(m, lambda x: round(x / greatest(sqrt(list_dot_product(m, m)), 1e-12), 6)) AS unit FROM means WHERE sqrt(list_dot_product(m, m)) > 0"""


@query("mean_pool_heads", HEADS)
def _(t):
    part = F.when(F.col("vec_id") % 5 == 3, "title").when(F.col("vec_id") % 5 == 4, "abstract").otherwise("paragraph")
    rows = t.vectors().select("paper_id", part.alias("part"), F.col("label").cast("string").alias("text"), "vector")
    every = P.with_heads(rows.where("part = 'paragraph'"), rows.where("part <> 'paragraph'"))
    return P.mean_pool(every).select("paper_id", F.transform("vector", lambda x: rounded(x)).alias("unit"))


@query("mean_pool_paper", "SELECT paper_id, list_transform(v, lambda x: round(x, 6)) AS unit FROM paper_means")
def _(t):
    return P.mean_pool(t.vectors()).select("paper_id", F.transform("vector", lambda x: rounded(x)).alias("unit"))


# ---- sparse search

def _postings(t: Tables) -> DataFrame:
    """Postings of passages with their paper and whether they are fronts, from the id alone."""
    return E.term_weights(t.passages()).withColumns({"paper_id": X.paper_id_last(F.col("docid")), "is_front": X.is_front(F.col("docid"))})


def _sparse(t: Tables) -> DataFrame:
    return t.index().scores(t.topic_terms(), "paragraph")


def _body(t: Tables) -> DataFrame:
    return t.index().scores(t.topic_terms(), "paragraph", body=True).select("qid", "docid", "score")


def _best_body(t: Tables) -> DataFrame:
    return t.index().best(t.topic_terms(), "paragraph")


RANKED = "row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, {0}) AS rank"


def _shown(df: DataFrame, item: str) -> DataFrame:
    return df.select("qid", item, r6("score"), "rank")


@query("sparse_dot", "SELECT qid, docid, round(dot, 6) AS dot FROM dots")
def _(t):
    return t.index().dots(t.topic_terms(), "paragraph").select("qid", "docid", r6("dot"))


@query("rank_run", "SELECT qid, docid, round(score, 6) AS score, rank::INTEGER AS rank FROM sparse_body")
def _(t):
    return _shown(t.index().ranked(t.topic_terms(), "paragraph", body=True), "docid")


@query("topk_sparse", "SELECT qid, docid, round(score, 6) AS score, rank::INTEGER AS rank FROM sparse_body WHERE rank <= 100")
def _(t):
    return _shown(_best_body(t), "docid")


def padded_sql(item: str, hits: str, items: str, k: int = 100) -> str:
    """The k best of hits (qid, item, score), then other items in order of ids with score zero."""
    return f"""
, hits AS (SELECT *, {RANKED.format(item)} FROM ({hits})), every AS (SELECT t.qid, i.{item} FROM topics t, (SELECT DISTINCT {item} FROM {items}) i)
SELECT qid, {item}, round(score, 6) AS score, rank::INTEGER AS rank FROM (
  SELECT e.qid, e.{item}, coalesce(h.score, 0) AS score, row_number() OVER (PARTITION BY e.qid ORDER BY h.rank NULLS LAST, e.{item}) AS rank FROM every e LEFT JOIN hits h ON h.qid = e.qid AND h.{item} = e.{item}
) WHERE rank <= {k}"""


@query("q_sparse_paragraph", padded_sql("docid", "SELECT qid, docid, score FROM sparse WHERE NOT is_front", "(SELECT docid FROM passages WHERE NOT is_front)"))
def _(t):
    return _shown(t.index().search(t.topics(), t.topic_terms(), "paragraph"), "docid")


@query("q_followed_paragraph", SQL["q_sparse_paragraph"].removeprefix(WITH))
def _(t):
    index = t.followed_index()
    index.check("paragraph", papers=t.papers_with_passages())
    return _shown(index.search(t.topics(), t.topic_terms(), "paragraph"), "docid")


@query("paper_prints", """
, h AS (SELECT paper_id, ('0x' || substr(sha256(octet_length(encode(docid)) || ':' || docid || octet_length(encode(text)) || ':' || text), 1, 15))::BIGINT AS h FROM passages)
SELECT paper_id, count(*) || ':' || sum(h) AS print FROM h GROUP BY paper_id""")
def _(t):
    return t.followed_index().prints().select("paper_id", "print")


@query("maxp", "SELECT qid, paper_id, round(max(score), 6) AS score FROM sparse GROUP BY ALL")
def _(t):
    return R.maxp(_sparse(t)).select("qid", "paper_id", r6("score"))


@query("q_sparse_paper_maxp", padded_sql("paper_id", "SELECT qid, paper_id, max(score) AS score FROM sparse GROUP BY ALL", "passages"))
def _(t):
    return _shown(t.index().search(t.topics(), t.topic_terms(), "paper"), "paper_id")


@query("topk_padded", f"""
, hits AS (SELECT qid, paper_id, score, {RANKED.format('paper_id')} FROM (SELECT qid, paper_id, max(score) AS score FROM sparse GROUP BY ALL)),
every AS (SELECT t.qid, d.doc_id::VARCHAR AS paper_id FROM topics t, (SELECT DISTINCT doc_id FROM documents) d)
SELECT qid, paper_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
  SELECT e.qid, e.paper_id, coalesce(h.score, 0) AS score, row_number() OVER (PARTITION BY e.qid ORDER BY h.rank NULLS LAST, e.paper_id) AS rank FROM every e LEFT JOIN hits h ON h.qid = e.qid AND h.paper_id = e.paper_id
) WHERE rank <= 900""")
def _(t):
    ranked = t.index().best(t.topic_terms(), "paper", k=900)
    papers = t.table("documents").select(F.col("doc_id").cast("string").alias("paper_id"))
    return _shown(R.padded(ranked, t.topics(), papers, 900, "paper_id"), "paper_id")


POOLED = """SELECT qid, paper_id, dot / pn.norm / topic_norms.norm AS score FROM (SELECT q.qid, p.paper_id, sum(q.weight * p.weight) AS dot FROM paper_postings p JOIN topic_terms q USING (term) GROUP BY ALL)
  JOIN (SELECT paper_id, greatest(sqrt(sum(weight * weight)), 1e-12) AS norm FROM paper_postings GROUP BY paper_id) pn USING (paper_id) JOIN topic_norms USING (qid)"""


@query("q_sparse_paper_pool", padded_sql("paper_id", POOLED, "passages"))
def _(t):
    return _shown(t.index().search(t.topics(), t.topic_terms(), "paper", "pool"), "paper_id")


# ---- dense search

@query("dense_cosine", "SELECT qid, docid, round(score, 6) AS score FROM dense")
def _(t):
    return R.dense_scores(t.queries(), t.vectors()).select("qid", "docid", r6("score"))


@query("topk_dense", "SELECT qid, docid, round(score, 6) AS score, rank::INTEGER AS rank FROM full_run")
def _(t):
    return _shown(t.run_full(), "docid")


@query("q_dense_paragraph", "SELECT qid, docid, round(score, 6) AS score, rank::INTEGER AS rank FROM full_run")
def _(t):
    return _shown(t.dense().search(t.queries(), "paragraph"), "docid")


@query("query_similarity", "SELECT a.qid, b.qid AS other, round(list_dot_product(a.v, b.v), 6) AS similarity FROM queries a, queries b")
def _(t):
    others = t.queries().select(F.col("qid").alias("other"), "vector")
    return R.dense_scores(t.queries(), others, "other").select("qid", "other", r6("score", "similarity"))


BEST = "SELECT qid, paper_id, arg_min(docid, (-round(score, 9), docid)) AS docid, max(score) AS score FROM dense GROUP BY ALL"


def _best(t: Tables, k: int | None = None) -> DataFrame:
    return R.dense_best_passages(t.queries(), t.vectors(), k)


@query("best_passage", f"SELECT qid, paper_id, docid, round(score, 6) AS score FROM ({BEST})")
def _(t):
    return _best(t).select("qid", "paper_id", "docid", r6("score"))


@query("papers_from_paragraphs", f"SELECT qid, paper_id, docid, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, {RANKED.format('paper_id')} FROM ({BEST})) WHERE rank <= 100")
def _(t):
    return R.rank(_best(t, 100), "paper_id", k=100).select("qid", "paper_id", "docid", r6("score"), "rank")


@query("q_dense_paper_maxp", f"SELECT qid, paper_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, {RANKED.format('paper_id')} FROM ({BEST})) WHERE rank <= 100")
def _(t):
    return _shown(t.dense().search(t.queries(), "paper"), "paper_id")


@query("q_dense_paper_mean", f"SELECT qid, paper_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, {RANKED.format('paper_id')} FROM (SELECT qid, paper_id, list_dot_product(q.v, m.v) AS score FROM queries q, paper_means m)) WHERE rank <= 100")
def _(t):
    return _shown(t.dense().search(t.queries(), "paper", "mean"), "paper_id")


# ---- reranking

TOP = "SELECT qid, docid FROM sparse_body WHERE rank <= 100"
OVERLAP = "len(list_intersect(list_distinct(q.t), d.t)) / greatest(len(list_distinct(q.t)), 1)"


@query("rerank_input", f"SELECT c.qid, c.docid, q.query, p.text FROM ({TOP}) c JOIN topics q USING (qid) JOIN passages p USING (docid)")
def _(t):
    return R.rerank_input(_best_body(t).select("qid", "docid"), t.topics(), t.passages()).select("qid", "docid", "query", "text")


@query("rerank", f"SELECT qid, docid, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, {RANKED.format('docid')} FROM (SELECT c.qid, c.docid, {OVERLAP} AS score FROM ({TOP}) c JOIN topic_toks q USING (qid) JOIN toks d USING (docid)))")
def _(t):
    return _shown(R.rerank(_best_body(t), t.topics(), t.passages(), R.overlap_scorer), "docid")


#: The texts of vectors: a line of their document, or all of it.
TEXTS = r"""
, vec_texts AS (
  SELECT e.vec_id, list_filter(string_split_regex(lower(CASE WHEN d.text IS NULL THEN 'vector ' || e.vec_id WHEN length(trim(string_split(d.text, chr(10))[e.vec_id % 5 + 1], ' ')) > 0 THEN string_split(d.text, chr(10))[e.vec_id % 5 + 1] ELSE d.text END), '\s+'), lambda t: t <> '') AS t
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id // 5
)"""


@query("q_rerank_paragraph", f"{TEXTS} SELECT qid, docid, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, {RANKED.format('docid')} FROM (SELECT c.qid, c.docid, {OVERLAP} AS score FROM full_run c JOIN vec_texts q ON q.vec_id = c.qid JOIN vecs v USING (docid) JOIN vec_texts d ON d.vec_id = v.vec_id))")
def _(t):
    return _shown(t.dense().search(t.queries(), "paragraph", "crossencoder", 100, R.overlap_scorer, t.dense_texts(), t.dense_topics()), "docid")


@query("q_rerank_paper", f"""{TEXTS}
, top AS (SELECT qid, paper_id, docid FROM (SELECT *, {RANKED.format('paper_id')} FROM ({BEST})) WHERE rank <= 100)
SELECT qid, paper_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, {RANKED.format('paper_id')} FROM (SELECT c.qid, c.paper_id, {OVERLAP} AS score FROM top c JOIN vec_texts q ON q.vec_id = c.qid JOIN vecs v USING (docid) JOIN vec_texts d ON d.vec_id = v.vec_id))""")
def _(t):
    return _shown(t.dense().search(t.queries(), "paper", "crossencoder", 100, R.overlap_scorer, t.dense_texts(), t.dense_topics()), "paper_id")


# ---- runs and metrics

@query("run_judged", "SELECT run, qid, docid, rank::INTEGER AS rank, rel FROM judged")
def _(t):
    return M.judged(t.runs(), t.qrels()).select("run", "qid", "docid", "rank", "rel")


@query("trec_lines", "SELECT run, qid, rank::INTEGER AS rank, qid || ' Q0 ' || docid || ' ' || rank || ' ' || printf('%.6f', score) || ' ' || run AS line FROM runs")
def _(t):
    return C.run_lines(t.runs())


@query("run_roundtrip", "SELECT run, qid::VARCHAR AS qid, docid, rank::INTEGER AS rank, printf('%.6f', score)::DOUBLE AS score FROM runs")
def _(t):
    path = f"{workspace.shared_dir(t.spark)}/run-{uuid.uuid4().hex}"
    C.write_run(t.runs(), path)
    return C.read_run(t.spark, path)


def _metric(name: str, column: str, level: int = 1):
    @query(name, f"SELECT run, qid, round({column}, 6) AS value FROM wide WHERE level = {level}")
    def _(t):
        return M.per_query(t.written_runs(), t.qrels(), level, (column,)).select("run", "qid", r6("value"))


for _name, _column in (("ndcg", "ndcg"), ("ndcg5", "ndcg5"), ("mrr", "mrr")):
    _metric(_name, _column)


@query("precision_at_k", "SELECT run, qid, metric, round(value, 6) AS value FROM vals WHERE level = 1 AND metric IN ('p5', 'p10')")
def _(t):
    return M.per_query(t.written_runs(), t.qrels(), 1, ("p5", "p10")).select("run", "qid", "metric", r6("value"))


def _partial(t: Tables) -> DataFrame:
    """Runs that lack some judged queries and have an unjudged one."""
    runs = t.written_runs()
    return runs.where("qid % 75 <> 0").unionByName(runs.where("qid = 50").withColumn("qid", F.lit(-1).cast("long")))


@query("metrics_comparable", "SELECT run, round(avg(CASE WHEN qid % 75 <> 0 THEN mrr ELSE 0 END), 6) AS mrr_mean, count(*) AS n FROM wide WHERE level = 1 GROUP BY run")
def _(t):
    v = M.per_query(_partial(t), t.qrels(), 1, ("mrr",))
    return v.groupBy("run").agg(F.round(F.avg("value"), 6).alias("mrr_mean"), F.count("*").alias("n"))


@query("metrics_graded", "SELECT run, metric, round(avg(value), 6) AS value FROM vals WHERE level = 1 GROUP BY ALL")
def _(t):
    return M.means(M.per_query(t.written_runs(), t.qrels())).select("run", "metric", r6("value"))


@query("metrics_strict", "SELECT run, metric, round(avg(value), 6) AS value FROM vals WHERE level = 2 AND metric IN ('mrr', 'p5') GROUP BY ALL")
def _(t):
    return M.means(M.per_query(t.written_runs(), t.qrels(), 2, ("mrr", "p5"))).select("run", "metric", r6("value"))


@query("plot_metrics", "SELECT run, round(value, 6) AS value, row_number() OVER (ORDER BY round(value, 9) DESC, run)::INTEGER AS place FROM (SELECT run, avg(ndcg) AS value FROM wide WHERE level = 1 GROUP BY run)")
def _(t):
    m = M.means(M.per_query(t.written_runs(), t.qrels(), 1, ("ndcg",)))
    return m.select("run", r6("value"), F.row_number().over(Window.orderBy(F.round("value", 9).desc(), "run")).alias("place"))


@query("pairwise_compare", "SELECT metric, run_a, run_b, qid, round(a, 6) AS a, round(b, 6) AS b FROM diffs WHERE level = 1")
def _(t):
    return M.pairs(M.per_query(t.written_runs(), t.qrels())).select("metric", "run_a", "run_b", "qid", r6("a"), r6("b"))


def _compared(t: Tables) -> DataFrame:
    return M.compared(M.per_query(t.written_runs(), t.qrels()))


@query("win_tie_loss", "SELECT metric, run_a, run_b, wins, ties, losses FROM tests WHERE level = 1")
def _(t):
    return _compared(t).select("metric", "run_a", "run_b", "wins", "ties", "losses")


@query("paired_t", "SELECT metric, run_a, run_b, round(t, 6) AS t, df FROM tests WHERE level = 1")
def _(t):
    return _compared(t).select("metric", "run_a", "run_b", r6("t"), "df")


#: p from the finite series for whole degrees of freedom; the library folds a continued fraction.
PAIRED_P = """
, angles AS (SELECT *, atan(abs(t) / sqrt(df)) AS a FROM tests WHERE level = 1),
series AS (
  SELECT *, CASE WHEN t IS NULL THEN NULL WHEN df % 2 = 1 THEN 1 - 2 / pi() * (a + sin(a) * cos(a) * coalesce(list_sum(list_transform(range((df - 1) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(cos(a), 2 * k))), 0))
    ELSE 1 - sin(a) * list_sum(list_transform(range(df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow(cos(a), 2 * k))) END AS p FROM angles
)
SELECT metric, run_a, run_b, round(p, 6) AS p, CASE WHEN p = 0 THEN 0.0 ELSE round(p * pow(10.0, 2 - floor(log10(abs(p))))) / pow(10.0, 2 - floor(log10(abs(p)))) END AS p_shown,
  CASE WHEN p < 0.05 THEN CASE WHEN mean_a > mean_b THEN run_a ELSE run_b END END AS better FROM series"""


@query("paired_p", PAIRED_P)
def _(t):
    return _compared(t).select("metric", "run_a", "run_b", r6("p"), "p_shown", "better")


def _evaluated(t: Tables) -> V.Outcome:
    """Two systems on the vectors, at paragraph level: one that is measured, and one set that only the first is run on."""
    systems = [
        V.System("full", lambda topics, level, k: t.dense().search(t.queries().join(topics.select("qid"), "qid", "left_semi"), level, k=k), ("paragraph",), on_test=True, save="dense", check=lambda: t.dense().check()),
        V.System("half", lambda topics, level, k: t.run_half(k).join(topics.select("qid"), "qid", "left_semi"), ("paragraph",)),
    ]
    sets = [V.QuerySet("study", t.query_texts(), {"paragraph": t.qrels()}), V.QuerySet("test", t.query_texts().where("qid % 50 = 0"))]
    return V.run_evaluation(t.spark, systems, sets, V.Settings(levels=("paragraph",)))


@query("q_evaluate", "SELECT run, level, metric, round(avg(value), 6) AS value FROM vals WHERE level = 1 OR metric IN ('mrr', 'p5') GROUP BY ALL")
def _(t):
    return _evaluated(t).reports["study", "paragraph"].means.select("run", "level", "metric", r6("value"))


@query("q_evaluate_runs", "SELECT 'study' AS set, run, qid::VARCHAR AS qid, docid, rank::INTEGER AS rank, round(score, 6) AS score FROM runs UNION ALL SELECT 'test', run, qid::VARCHAR, docid, rank::INTEGER, round(score, 6) FROM full_run WHERE qid % 50 = 0")
def _(t):
    return _evaluated(t).runs.select("set", "run", "qid", "docid", "rank", r6("score"))


@query("q_evaluate_latency", "SELECT 'study' AS set, run AS method, qid::VARCHAR AS qid, true AS timed FROM (SELECT DISTINCT run, qid FROM runs) UNION ALL SELECT 'test', 'full', qid::VARCHAR, true FROM queries WHERE qid % 50 = 0")
def _(t):
    return _evaluated(t).latency.select("set", "method", "qid", (F.col("ms") > 0).alias("timed"))


#: An evaluation as a settings file gives it: every kind of system, at both levels.
CONFIG = {
    "team_name": "team", "levels": ["paper", "paragraph"], "k": 100, "sets": [{"name": "study", "metrics": True}, {"name": "test", "metrics": False}],
    "models": {
        "words": {"type": "sparse", "save_id": "sparse", "do_test": True},
        "near": {"type": "dense", "level": "paragraph", "paragraph_method": "cosine_similarity", "save_id": "dense", "do_test": True},
        "near-papers": {"type": "dense", "level": "paper", "paper_method": "from_paragraphs"},
        "near-means": {"type": "dense", "level": "paper", "paper_method": "mean_pooling"},
        "reread": {"type": "dense", "level": "paragraph", "paragraph_method": "crossencoder"},
        "reread-papers": {"type": "dense", "level": "paper", "paper_method": "crossencoder"},
    },
}


def _all_systems(t: Tables) -> V.Outcome:
    settings, names = V.settings_of(CONFIG)
    index, dense = t.text_index(), t.dense()
    words = V.Model(index, lambda topics: E.term_weights(topics.withColumnRenamed("query", "text"), "qid"), papers=t.vectors().select("paper_id").distinct().count())
    near = V.Model(dense, lambda topics: t.queries().join(topics.select("qid"), "qid", "left_semi"), scorer=R.overlap_scorer, texts=t.dense_texts())
    systems = V.systems_of(CONFIG, {name: words if name == "words" else near for name in CONFIG["models"]})
    topics = t.dense_topics()
    sets = [V.QuerySet(name, topics, {"paragraph": t.qrels(), "paper": t.paper_qrels()} if measured else None) for name, measured in names]
    return V.run_evaluation(t.spark, systems, sets, settings)


def _depth(run: str, level: str, hits: str, item: str = "docid") -> str:
    return f"SELECT '{level}' AS side, '{run}' AS run, qid, {item} AS item, rank FROM (SELECT *, {RANKED.format(item)} FROM ({hits})) WHERE rank <= 100"


ALL_SYSTEMS = TEXTS + f"""
, vpost AS (SELECT docid, paper_id, term, ln(1 + count(*)) AS weight FROM (SELECT v.docid, v.paper_id, unnest(x.t) AS term FROM vecs v JOIN vec_texts x USING (vec_id)) GROUP BY ALL),
vterm AS (SELECT qid, term, ln(1 + count(*)) AS weight FROM (SELECT q.qid, unnest(x.t) AS term FROM queries q JOIN vec_texts x ON x.vec_id = q.qid) GROUP BY ALL),
vqn AS (SELECT qid, sqrt(sum(weight * weight)) AS n FROM vterm GROUP BY qid), vpn AS (SELECT docid, sqrt(sum(weight * weight)) AS n FROM vpost GROUP BY docid),
vpaper AS (SELECT paper_id, term, max(weight) AS weight FROM vpost GROUP BY ALL), vppn AS (SELECT paper_id, sqrt(sum(weight * weight)) AS n FROM vpaper GROUP BY paper_id),
vscore AS (SELECT qid, docid, paper_id, sum(q.weight * p.weight) / any_value(vpn.n) / any_value(vqn.n) AS score FROM vpost p JOIN vterm q USING (term) JOIN vpn USING (docid) JOIN vqn USING (qid) GROUP BY ALL),
vpool AS (SELECT qid, paper_id, sum(q.weight * p.weight) / any_value(vppn.n) / any_value(vqn.n) AS score FROM vpaper p JOIN vterm q USING (term) JOIN vppn USING (paper_id) JOIN vqn USING (qid) GROUP BY ALL),
zero_par AS (SELECT q.qid, v.docid, coalesce(s.score, 0) AS score FROM queries q CROSS JOIN vecs v LEFT JOIN vscore s ON s.qid = q.qid AND s.docid = v.docid WHERE NOT regexp_matches(v.docid, '_0$')),
vbest AS (SELECT qid, paper_id, max(score) AS score FROM vscore GROUP BY ALL), vids AS (SELECT DISTINCT paper_id FROM vecs),
zero_maxp AS (SELECT q.qid, v.paper_id, coalesce(s.score, 0) AS score FROM queries q CROSS JOIN vids v LEFT JOIN vbest s ON s.qid = q.qid AND s.paper_id = v.paper_id),
zero_pool AS (SELECT q.qid, v.paper_id, coalesce(s.score, 0) AS score FROM queries q CROSS JOIN vids v LEFT JOIN vpool s ON s.qid = q.qid AND s.paper_id = v.paper_id),
best_of AS ({BEST}), top_papers AS (SELECT qid, paper_id, docid FROM (SELECT *, {RANKED.format('paper_id')} FROM best_of) WHERE rank <= 100),
every_run AS (
  {_depth('words', 'paragraph', 'SELECT * FROM zero_par')} UNION ALL {_depth('words', 'paper', 'SELECT * FROM zero_maxp', 'paper_id')} UNION ALL {_depth('words-pool', 'paper', 'SELECT * FROM zero_pool', 'paper_id')}
  UNION ALL {_depth('near', 'paragraph', 'SELECT * FROM dense')} UNION ALL {_depth('near-papers', 'paper', 'SELECT * FROM best_of', 'paper_id')}
  UNION ALL {_depth('near-means', 'paper', 'SELECT qid, paper_id, list_dot_product(q.v, m.v) AS score FROM queries q, paper_means m', 'paper_id')}
  UNION ALL {_depth('reread', 'paragraph', f'SELECT c.qid, c.docid, {OVERLAP} AS score FROM full_run c JOIN vec_texts q ON q.vec_id = c.qid JOIN vecs v USING (docid) JOIN vec_texts d ON d.vec_id = v.vec_id')}
  UNION ALL {_depth('reread-papers', 'paper', f'SELECT c.qid, c.paper_id, {OVERLAP} AS score FROM top_papers c JOIN vec_texts q ON q.vec_id = c.qid JOIN vecs v USING (docid) JOIN vec_texts d ON d.vec_id = v.vec_id', 'paper_id')}
), every_rel AS (
  SELECT 'paragraph' AS side, qid, docid AS item, rel FROM qrels UNION ALL SELECT 'paper', qid, split_part(docid, '_', 1), max(rel) FROM qrels GROUP BY ALL
), every_ideal AS (
  SELECT side, level, qid, sum(g / log2(place + 1)) AS best, sum(CASE WHEN place <= 5 THEN g / log2(place + 1) ELSE 0 END) AS best5
  FROM (SELECT side, level, qid, g, row_number() OVER (PARTITION BY side, level, qid ORDER BY g DESC, item) AS place FROM (SELECT side, level, qid, item, CASE WHEN rel >= level THEN rel ELSE 0 END AS g FROM every_rel, levels)) GROUP BY ALL
), every_sum AS (
  SELECT side, level, run, qid, sum(g / log2(rank + 1)) AS dcg, sum(CASE WHEN rank <= 5 THEN g / log2(rank + 1) ELSE 0 END) AS dcg5, coalesce(1 / min(CASE WHEN g > 0 THEN rank END), 0) AS mrr,
    sum(CASE WHEN g > 0 AND rank <= 5 THEN 1 ELSE 0 END) / 5 AS p5, sum(CASE WHEN g > 0 AND rank <= 10 THEN 1 ELSE 0 END) / 10 AS p10
  FROM (SELECT r.side, level, run, r.qid, rank, CASE WHEN coalesce(j.rel, 0) >= level THEN coalesce(j.rel, 0) ELSE 0 END AS g FROM every_run r LEFT JOIN every_rel j ON j.side = r.side AND j.qid = r.qid AND j.item = r.item, levels) GROUP BY ALL
), every_wide AS (
  SELECT i.side, i.level, r.run, CASE WHEN best > 0 THEN coalesce(dcg, 0) / best ELSE 0 END AS ndcg, CASE WHEN best5 > 0 THEN coalesce(dcg5, 0) / best5 ELSE 0 END AS ndcg5, coalesce(mrr, 0) AS mrr, coalesce(p5, 0) AS p5, coalesce(p10, 0) AS p10
  FROM every_ideal i JOIN (SELECT DISTINCT side, run FROM every_run) r ON r.side = i.side LEFT JOIN every_sum s ON s.side = i.side AND s.level = i.level AND s.run = r.run AND s.qid = i.qid
)
SELECT side AS searched, run, level, metric, round(avg(value), 6) AS value FROM (UNPIVOT every_wide ON ndcg, ndcg5, mrr, p5, p10 INTO NAME metric VALUE value) WHERE level = 1 OR metric IN ('mrr', 'p5') GROUP BY ALL"""


@query("q_evaluate_systems", ALL_SYSTEMS)
def _(t):
    out = _all_systems(t)
    parts = [out.reports["study", level].means.select(F.lit(level).alias("searched"), "run", "level", "metric", r6("value")) for level in V.LEVELS]
    return parts[0].unionByName(parts[1])


MEANS = "SELECT run, level, metric, round(avg(value), 6) AS value FROM vals WHERE level = 1 OR metric IN ('mrr', 'p5') GROUP BY ALL"


@query("report_json", f"SELECT run, level, to_json(MAP(list(metric ORDER BY metric), list(value ORDER BY metric)))::VARCHAR AS report FROM ({MEANS}) GROUP BY ALL")
def _(t):
    return C.report_json(V.evaluate(t.written_runs(), t.qrels()).means.withColumn("value", F.round("value", 6)))


@query("summary_report", f"""
, m AS (SELECT level, run, MAP(list(metric ORDER BY metric), list(value ORDER BY metric)) AS v FROM ({MEANS}) GROUP BY ALL),
p AS (SELECT level, CASE level WHEN 1 THEN 'relevant_or_partial' ELSE 'relevant_only' END AS name, MAP(list(run ORDER BY run), list(v ORDER BY run)) AS metrics FROM m GROUP BY ALL)
SELECT to_json(struct_pack("set" := 'study', level := 'paragraph', k := 100, relevance_passes := MAP(list(name ORDER BY name), list(struct_pack(relevance_level := level, metrics := metrics) ORDER BY name))))::VARCHAR AS report FROM p""")
def _(t):
    return C.summary_report(V.evaluate(t.written_runs(), t.qrels()).means.withColumn("value", F.round("value", 6)), {"set": "study", "level": "paragraph", "k": 100})


@query("summary_file", f"SELECT 'study' AS set, 'paragraph' AS level_name, * FROM ({MEANS})")
def _(t):
    path = f"{workspace.shared_dir(t.spark)}/summary-{uuid.uuid4().hex}"
    C.write_report(C.summary_report(V.evaluate(t.written_runs(), t.qrels()).means.withColumn("value", F.round("value", 6)), {"set": "study", "level": "paragraph"}), path)
    return C.read_summary(t.spark, path)


@query("query_report", """
, m AS (SELECT level, qid::VARCHAR AS qid, run, MAP(list(metric ORDER BY metric), list(round(value, 6) ORDER BY metric)) AS v FROM vals WHERE level = 1 OR metric IN ('mrr', 'p5') GROUP BY ALL),
r AS (SELECT level, qid, MAP(list(run ORDER BY run), list(v ORDER BY run)) AS runs FROM m GROUP BY ALL),
p AS (SELECT level, CASE level WHEN 1 THEN 'relevant_or_partial' ELSE 'relevant_only' END AS name, MAP(list(qid ORDER BY qid), list(runs ORDER BY qid)) AS queries FROM r GROUP BY ALL)
SELECT to_json(struct_pack("set" := 'study', relevance_passes := MAP(list(name ORDER BY name), list(struct_pack(relevance_level := level, queries := queries) ORDER BY name))))::VARCHAR AS report FROM p""")
def _(t):
    return C.query_report(V.evaluate(t.written_runs(), t.qrels()).values.withColumn("value", F.round("value", 6)), {"set": "study"})


@query("significance_report")
def _(t):
    return C.significance_report(V.evaluate(t.written_runs(), t.qrels(), order=("half", "full")).comparisons, {"set": "study", "stat_test": "student", "max_p": 0.05})


_SERIES = PAIRED_P.replace("level = 1)", "level = 1 OR metric IN ('mrr', 'p5'))").partition("SELECT metric, run_a, run_b, round(p, 6) AS p, ")


@query("significance_file", f"{_SERIES[0]}SELECT 'study' AS set, level, run_a, run_b, metric, wins, ties, losses, {_SERIES[2].replace('AS p_shown', 'AS p')}")
def _(t):
    path = f"{workspace.shared_dir(t.spark)}/significance-{uuid.uuid4().hex}"
    C.write_report(C.significance_report(V.evaluate(t.written_runs(), t.qrels()).comparisons, {"set": "study", "stat_test": "student", "max_p": 0.05}), path)
    return C.read_significance(t.spark, path)


@query("win_tie_loss_ordered", "SELECT level, metric, run_b AS run_a, run_a AS run_b, losses AS wins, ties, wins AS losses FROM tests WHERE level = 1 OR metric IN ('mrr', 'p5')")
def _(t):
    return V.evaluate(t.written_runs(), t.qrels(), order=("half", "full")).comparisons.select("level", "metric", "run_a", "run_b", "wins", "ties", "losses")


# ---- training data

@query("eligible_queries", "SELECT qid FROM qrels GROUP BY qid HAVING bool_or(rel >= 2) AND bool_or(rel = 1)")
def _(t):
    return L.eligible(t.qrels())


@query("max_grade_positives", "SELECT qid, docid, rel FROM (SELECT *, max(rel) OVER (PARTITION BY qid) AS top FROM positives) WHERE rel = top")
def _(t):
    return L.max_grade_positives(t.qrels())


@query("pick_positive", "SELECT qid, drawn, first FROM picks")
def _(t):
    return L.pick_positive(t.qrels())


@query("training_pairs", "SELECT qid, pos, neg FROM pairs")
def _(t):
    return L.training_pairs(t.qrels())


ROWS = "SELECT qid, 'query ' || qid AS query, list(DISTINCT 'passage ' || docid ORDER BY 'passage ' || docid) FILTER (rel >= 2) AS pos, list(DISTINCT 'passage ' || docid ORDER BY 'passage ' || docid) FILTER (rel = 1) AS neg FROM qrels GROUP BY qid HAVING bool_or(rel >= 2) AND bool_or(rel = 1)"


@query("training_rows", ROWS)
def _(t):
    return L.training_rows(t.qrels(), t.query_texts(), t.vector_texts())


STATS = ROWS.replace("FROM qrels GROUP", "FROM qrels WHERE docid IN (SELECT docid FROM vecs WHERE vec_id % 3 <> 0) GROUP")


@query("training_stats", f"""
, kept AS ({STATS}), judged_docs AS (SELECT DISTINCT docid FROM qrels WHERE rel > 0)
SELECT count(*) AS rows, sum(len(pos))::BIGINT AS positives, sum(len(neg))::BIGINT AS negatives, (SELECT count(DISTINCT qid) FROM qrels) - count(*) AS skipped,
  (SELECT count(*) FROM judged_docs WHERE docid NOT IN (SELECT docid FROM vecs WHERE vec_id % 3 <> 0)) AS missing FROM kept""")
def _(t):
    texts = t.vector_texts().join(t.vectors().where("vec_id % 3 <> 0").select("docid"), "docid", "left_semi")  # a third of the judged passages have no text
    return L.training_stats(L.training_rows(t.qrels(), t.query_texts(), texts), t.qrels(), texts)


def _split(name: str, f, size: str):
    @query(name, f"SELECT qid, row_number() OVER (ORDER BY md5('42|' || qid), qid) <= {size} AS is_validation FROM (SELECT qid, count(*) OVER () AS n FROM (SELECT DISTINCT qid FROM qrels))")
    def _(t):
        return f(t.qrels())


_split("split_80_20", L.split_80_20, "greatest(2, n // 5)")
_split("split_90_10", L.split_90_10, "n - greatest(1, floor(n * 0.9))")
_split("split_eligible", lambda q: L.split_eligible(q.join(L.eligible(q), "qid", "left_semi")), "least(greatest(1, round_even(n * 0.1, 0)), n - 1)")


def _batched(t: Tables) -> DataFrame:
    return L.batches(L.pick_positive(t.qrels()).select("qid", F.col("drawn").alias("docid")))


@query("usable_batches", "SELECT batch FROM (SELECT drawn AS docid, ((row_number() OVER (ORDER BY md5('42|' || qid), qid) - 1) // 4)::INTEGER AS batch FROM picks) GROUP BY batch HAVING count(DISTINCT docid) = 4")
def _(t):
    drawn = L.pick_positive(t.qrels()).select("qid", F.col("drawn").alias("docid"))
    return L.usable(L.batches(drawn, 4), size=4)


@query("diverse_batches")
def _(t):
    return L.diverse_batches(t.queries())


def _candidates(t: Tables) -> DataFrame:
    b = _batched(t)
    pairs = b.select("batch", "qid", F.col("docid").alias("mine")).join(b.select("batch", "docid").distinct(), "batch")
    scored = t.pair_scores(pairs, "docid", "s")
    known = t.qrels().select("qid", "docid", F.lit(True).alias("hit"))
    return scored.join(known, ["qid", "docid"], "left").select("qid", (F.col("s") / 0.05).alias("score"), F.coalesce("hit", F.lit(False)).alias("positive"), (F.col("mine") == F.col("docid")).alias("own"))


LOSS = "SELECT qid, ln(sum(exp(s - m))) - ln(sum(CASE WHEN {0} THEN exp(s - m) END)) AS loss FROM (SELECT *, max(s) OVER (PARTITION BY qid) AS m FROM cands) GROUP BY qid"


@query("infonce_loss", f"SELECT qid, round(loss, 6) AS loss FROM ({LOSS.format('positive')})")
def _(t):
    return L.infonce(_candidates(t).select("qid", "score", "positive")).select("qid", r6("loss"))


@query("infonce_inbatch", f"SELECT qid, round(loss, 6) AS loss FROM ({LOSS.format('own')})")
def _(t):
    return L.infonce(_candidates(t).select("qid", "score", F.col("own").alias("positive"))).select("qid", r6("loss"))


@query("flops_reg", "SELECT round(sum(m * m), 6) AS flops FROM (SELECT sum(weight) / (SELECT count(*) FROM topics)::DOUBLE AS m FROM topic_terms GROUP BY term)")
def _(t):
    return L.flops(t.topic_terms(), t.topics().count()).select(r6("flops"))


@query("pairwise_logloss", "SELECT round(avg(greatest(x, 0) + ln(1 + exp(-abs(x)))), 6) AS loss FROM (SELECT list_dot_product(q.v, n.v) - list_dot_product(q.v, p.v) AS x FROM pairs JOIN queries q USING (qid) JOIN vecs p ON p.docid = pos JOIN vecs n ON n.docid = neg)")
def _(t):
    scored = t.pair_scores(t.pair_scores(L.training_pairs(t.qrels()), "pos", "pos_score"), "neg", "neg_score")
    return L.pairwise_logistic(scored).select(r6("loss"))


@query("epoch_loss", "SELECT event_type AS epoch, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) AS weighted, round(avg(value), 6) AS plain FROM events GROUP BY event_type")
def _(t):
    steps = t.table("events").select(F.col("event_type").alias("epoch"), F.col("value").alias("loss"), (F.col("event_id") % 7 + 1).alias("n"))
    return L.epoch_loss(steps).select("epoch", r6("weighted"), r6("plain"))


@query("best_epoch", "SELECT model, min(epoch) FILTER (v = low) AS earliest, max(epoch) FILTER (v = low) AS latest FROM (SELECT *, min(v) OVER (PARTITION BY model) AS low FROM (SELECT event_type AS model, event_id % 20 AS epoch, min(floor(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL)) GROUP BY model")
def _(t):
    history = t.table("events").where("value is not null").groupBy(F.col("event_type").alias("model"), (F.col("event_id") % 20).alias("epoch")).agg(F.min(F.floor("value")).alias("val_loss"))
    return L.best_epoch(history)


@query("dedup_in_order", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def _(t):
    return L.first_of(t.table("events").select("event_id", "user_id"), "user_id", "event_id")


@query("split_file", "SELECT qid, row_number() OVER (ORDER BY md5('42|' || qid), qid) <= n - greatest(1, floor(n * 0.9)) AS is_validation FROM (SELECT qid, count(*) OVER () AS n FROM (SELECT DISTINCT qid FROM qrels))")
def _(t):
    path = f"{workspace.shared_dir(t.spark)}/split-{uuid.uuid4().hex}"
    C.write_split(L.split_90_10(t.qrels()), path)
    return C.read_split(t.spark, path, "bigint")


@query("history_file", "SELECT event_type AS model, event_id % 20 AS epoch, max(value) AS train_loss, min(value) AS val_loss FROM events WHERE value IS NOT NULL GROUP BY ALL")
def _(t):
    path = f"{workspace.shared_dir(t.spark)}/history-{uuid.uuid4().hex}"
    history = t.table("events").where("value is not null").groupBy(F.col("event_type").alias("model"), (F.col("event_id") % 20).alias("epoch")).agg(F.max("value").alias("train_loss"), F.min("value").alias("val_loss"))
    C.write_history(history, path)
    return C.read_history(t.spark, path)


@query("training_file", ROWS)
def _(t):
    path = f"{workspace.shared_dir(t.spark)}/training-{uuid.uuid4().hex}"
    rows = L.training_rows(t.qrels(), t.query_texts(), t.vector_texts())
    C.write_training(rows, path)
    return t.spark.read.schema("query string, pos array<string>, neg array<string>").json(path).withColumn("qid", F.regexp_extract("query", "[0-9]+", 0).cast("long"))


# ---- indexes and reports

NUMBERED = "SELECT doc_id::VARCHAR AS paper_id, (row_number() OVER (ORDER BY doc_id::VARCHAR) - 1) // 100 + 1 AS shard FROM (SELECT DISTINCT doc_id FROM documents)"


def _shards(t: Tables) -> DataFrame:
    names = t.table("documents").select(F.col("doc_id").cast("string").alias("paper_id")).distinct()
    return numbered(names, "paper_id").withColumn("shard", F.expr("(place - 1) div 100 + 1")).drop("place")


@query("index_shards", f"SELECT shard, count(*) AS papers, min(paper_id) AS first_paper, max(paper_id) AS last_paper FROM ({NUMBERED}) GROUP BY shard")
def _(t):
    return _shards(t).groupBy("shard").agg(F.count("*").alias("papers"), F.min("paper_id").alias("first_paper"), F.max("paper_id").alias("last_paper"))


@query("index_complete", "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS files, (SELECT count(DISTINCT paper_id) FROM postings) AS indexed, (SELECT count(DISTINCT doc_id) FROM documents) = (SELECT count(DISTINCT paper_id) FROM postings) AS complete")
def _(t):
    index = t.index()
    index.check("paragraph")
    files = t.table("documents").agg(F.countDistinct("doc_id").alias("files"))
    indexed = index.postings("paper").agg(F.countDistinct("docid").alias("indexed"))
    return files.crossJoin(indexed).select("files", "indexed", (F.col("files") == F.col("indexed")).alias("complete"))


@query("index_bytes")
def _(t):
    return C.index_bytes(t.spark, f"{t.dir}/embeddings.parquet")


def _latency(t: Tables) -> DataFrame:
    return t.table("events").where("value is not null").select(F.col("event_type").alias("method"), F.col("event_id").alias("qid"), F.col("value").alias("ms"))


@query("steady_latency", "SELECT method, round(avg(ms), 6) AS mean_ms FROM (SELECT event_type AS method, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE value IS NOT NULL) WHERE n > 1 GROUP BY method")
def _(t):
    return V.steady_mean(_latency(t)).select("method", r6("mean_ms"))


@query("plot_latency", "SELECT method, round(mean_ms, 6) AS mean_ms, row_number() OVER (ORDER BY round(mean_ms, 9), method)::INTEGER AS place FROM (SELECT event_type AS method, avg(value) AS mean_ms FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE value IS NOT NULL) WHERE n > 1 GROUP BY event_type)")
def _(t):
    return V.steady_mean(_latency(t)).select("method", r6("mean_ms"), F.row_number().over(Window.orderBy(F.round("mean_ms", 9), "method")).alias("place"))


@query("plot_loss", "SELECT model, epoch, part, round(loss, 6) AS loss FROM (UNPIVOT (SELECT event_type AS model, event_id % 20 AS epoch, max(value) AS train_loss, min(value) AS val_loss FROM events WHERE value IS NOT NULL GROUP BY ALL) ON train_loss, val_loss INTO NAME part VALUE loss)")
def _(t):
    history = t.table("events").where("value is not null").groupBy(F.col("event_type").alias("model"), (F.col("event_id") % 20).alias("epoch")).agg(F.max("value").alias("train_loss"), F.min("value").alias("val_loss"))
    return V.loss_curves(history).select("model", "epoch", "part", r6("loss"))


@query("latency_carry_forward", """
, o AS (SELECT user_id, max(value) AS ms FROM events WHERE event_id % 2 = 0 GROUP BY user_id), n AS (SELECT user_id, max(value) AS ms FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
SELECT coalesce(o.user_id, n.user_id) AS method, coalesce(n.ms, o.ms) AS ms FROM o FULL JOIN n ON o.user_id = n.user_id""")
def _(t):
    part = lambda k: t.table("events").where(f"event_id % {k} = 0").groupBy(F.col("user_id").alias("method")).agg(F.max("value").alias("ms"))
    return V.carried_forward(part(3), part(2))


@query("merge_summaries", "SELECT event_type, user_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def _(t):
    return V.merged(t.table("events"), ("event_type", "user_id"), "event_id", "value")
