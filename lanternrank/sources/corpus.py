"""Readers and writers of corpora, topics, judgments, runs, reports and indexes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternrank.functions.text import front_text, strip

PAPER = "paper_id string, title string, abstract string, paragraphs map<string,string>"


def papers(spark: SparkSession, path: str, strict: bool = False, lines: bool = False) -> DataFrame:
    """Papers, one JSON file each, or with `lines` one a line of files of any size.

    strict: unreadable files, a missing id or paragraphs, an id unlike the file
    name and an empty folder are errors.  Else such files are left out; `skipped`
    names them.
    """
    if strict and lines:
        raise ValueError("a strict scan takes a file a paper")
    reader = spark.read.option("multiLine", not lines).option("pathGlobFilter", "*.json")
    if strict:
        rows = reader.schema(PAPER).option("mode", "FAILFAST").json(path)
        stem = F.regexp_replace("_metadata.file_name", r"\.json$", "")
        good = F.col("paragraphs").isNotNull() & F.col("paper_id").eqNullSafe(stem)
        checked = rows.withColumn("_ok", F.assert_true(good, F.concat(F.lit("bad paper file: "), F.col("_metadata.file_name"))))
        if rows.isEmpty():
            raise ValueError(f"no papers in {path}")
        return checked.where("_ok is null").drop("_ok")
    rows = reader.schema(PAPER + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where("_corrupt_record is null and paper_id is not null and paragraphs is not null").drop("_corrupt_record")


def skipped(spark: SparkSession, path: str) -> DataFrame:
    """file and reason of each paper file that a lenient scan leaves out."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").schema(PAPER + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    reason = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(F.col("paper_id").isNull(), "no id").when(F.col("paragraphs").isNull(), "no paragraphs")
    return rows.select(F.col("_metadata.file_name").alias("file"), reason.alias("reason")).where("reason is not null")


def write_papers(papers_: DataFrame, path: str) -> None:
    """paper_id, title, abstract and paragraphs as JSON, a paper a line."""
    papers_.select("paper_id", "title", "abstract", "paragraphs").write.mode("overwrite").json(path)


def passages(papers_: DataFrame, front: bool = False, clean: bool = False) -> DataFrame:
    """paper_id, docid, text, is_front of each paragraph; a repeated key's last text wins.

    front: adds each paper's head as `<paper_id>_0`.  clean: strips texts and
    leaves blank ones out.
    """
    body = papers_.select("paper_id", F.posexplode("paragraphs").alias("pos", "docid", "text"))
    body = body.groupBy("paper_id", "docid").agg(F.max_by("text", "pos").alias("text")).withColumn("is_front", F.lit(False))
    if front:
        head = papers_.select("paper_id", F.concat("paper_id", F.lit("_0")).alias("docid"), front_text(F.col("title"), F.col("abstract")).alias("text"), F.lit(True).alias("is_front"))
        body = body.unionByName(head)
    return body.withColumn("text", strip(F.col("text"))).where("text <> ''") if clean else body


def lookup(papers_: DataFrame, docids: list[str]) -> DataFrame:
    """docid and text of the named paragraphs: only their papers are kept, and only their entries taken out."""
    named = F.array(*[F.lit(d) for d in sorted(set(docids))])
    mine = papers_.where(F.col("paper_id").isin(sorted({d.rpartition("_")[0] or d for d in docids})))
    found = F.filter(F.transform(named, lambda d: F.struct(d.alias("docid"), F.element_at("paragraphs", d).alias("text"))), lambda x: F.isnotnull(x["text"]))
    return mine.select(F.explode(found).alias("x")).select("x.docid", "x.text")


def topics(spark: SparkSession, path: str, limit: int | None = None, ordinal: bool = False) -> DataFrame:
    """qid and query of a JSON file in any of its forms, in file order up to `limit`; ordinal: also their number in the file.

    Forms: a list of objects (qid, query_id or id; query, text or question),
    the same under "queries", or an object of ids to texts or objects.  Topic
    files are small and read on the driver.
    """
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    data = json.loads(text)
    if isinstance(data, dict) and "queries" in data:
        data = data["queries"]
    if isinstance(data, dict):
        data = [{"qid": k} | (v if isinstance(v, dict) else {"query": v}) for k, v in data.items()]
    first = lambda row, names: next((row[n] for n in names if n in row), None)
    rows = [(str(first(r, ("qid", "query_id", "id"))), first(r, ("query", "text", "question"))) for r in data]
    rows = [(*r, i) for i, r in enumerate(rows[:limit] if limit is not None else rows)]
    return spark.createDataFrame(rows, "qid string, query string, ordinal int").select("qid", "query", *["ordinal"] * ordinal)


def _fields(spark: SparkSession, path: str, separator: str) -> DataFrame:
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return rows.select(F.split(F.trim("value"), separator).alias("f"), F.monotonically_increasing_id().alias("line"))


def qrels(spark: SparkSession, path: str, positive_only: bool = False, tabs_only: bool = False) -> DataFrame:
    """qid, docid, rel of a four-column file; the last of repeated judgments wins."""
    rows = _fields(spark, path, r"\t" if tabs_only else r"\s+").select(F.get("f", F.lit(0)).alias("qid"), F.get("f", F.lit(2)).alias("docid"), F.get("f", F.lit(3)).cast("double").cast("int").alias("rel"), "line")
    out = rows.groupBy("qid", "docid").agg(F.max_by("rel", "line").alias("rel"))
    return out.where("rel > 0") if positive_only else out


def asked(judgments: DataFrame, topics_: DataFrame) -> DataFrame:
    """Judgments of topics (qid, query) that have a text."""
    known = topics_.where(F.length(F.trim("query")) > 0).select("qid").distinct()
    return judgments.join(known, "qid", "left_semi")


def write_qrels(judgments: DataFrame, path: str) -> None:
    """Four columns, tabs between: qid, 0, docid, rel."""
    judgments.select(F.concat_ws("\t", F.col("qid").cast("string"), F.lit("0"), "docid", F.col("rel").cast("string")).alias("value")).write.mode("overwrite").text(path)


def qrel_path(folder: str, set_: str, level: str) -> str:
    return f"{folder}/{set_.capitalize()}_{level}_qrel.tsv"


def run_path(folder: str, team: str, level: str, method: str, set_: str, stem: bool = True) -> str:
    return f"{folder}/{team}_{level}_{method}_{set_}{'' if stem or method not in ('bm25', 'tfidf') else '_no-stem'}.tsv"


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """run, qid, docid, rank, score of a six-column file."""
    f = lambda i: F.get("f", F.lit(i))
    return _fields(spark, path, r"\s+").select(f(5).alias("run"), f(0).alias("qid"), f(2).alias("docid"), f(3).cast("int").alias("rank"), F.nullif(f(4), F.lit("null")).cast("double").alias("score"))


def _run_line() -> Column:
    """Six columns; halves of the sixth digit of a score go to the even one, as printf has them, which also writes nan and inf; what is missing is null."""
    score = F.bround("score", 6)
    shown = F.format_string("%.6f", F.when(score == 0, F.col("score") * 0).otherwise(score))  # a zero keeps its sign
    shown = F.replace(F.lower(shown), F.lit("infinity"), F.lit("inf"))
    return F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("docid"), F.col("rank").cast("string"), F.when(F.col("score").isNull(), "null").otherwise(shown), F.col("run"))


def run_lines(runs: DataFrame) -> DataFrame:
    """qid, rank and the six-column line of each row; none if it has no score."""
    return runs.select("run", "qid", "rank", F.when(F.col("score").isNotNull(), _run_line()).alias("line"))


def write_run(runs: DataFrame, path: str) -> None:
    """A folder of lines in order of query and rank; one query's lines stay in one file."""
    runs.select("qid", "rank", _run_line().alias("line")).repartitionByRange("qid").sortWithinPartitions("qid", "rank").select("line").write.mode("overwrite").text(path)


def write_training(rows: DataFrame, path: str, reuse: bool = True) -> None:
    rows.select("query", "pos", "neg").write.mode("ignore" if reuse else "overwrite").json(path)


def write_split(split: DataFrame, path: str) -> None:
    """The ids of a split as JSON: a row for each part (train, validation), ids in order.  Splits are bounded sets of queries."""
    part = F.when(F.col("is_validation"), "validation").otherwise("train")
    split.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list("qid")).alias("ids")).coalesce(1).write.mode("overwrite").json(path)


def read_split(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    rows = spark.read.schema(f"part string, ids array<{kind}>").json(path)
    return rows.select(F.explode("ids").alias("qid"), (F.col("part") == "validation").alias("is_validation"))


def write_history(history: DataFrame, path: str) -> None:
    """model, epoch, train_loss, val_loss as JSON, a file a model, in order of epochs."""
    history.select("model", "epoch", "train_loss", "val_loss").repartition("model").sortWithinPartitions("epoch").write.mode("overwrite").partitionBy("model").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """model, epoch, train_loss, val_loss; a file may call the last validation_loss."""
    rows = spark.read.schema("model string, epoch long, train_loss double, val_loss double, validation_loss double").json(path)
    return rows.select("model", "epoch", "train_loss", F.coalesce("val_loss", "validation_loss").alias("val_loss"))


def report_json(values: DataFrame) -> DataFrame:
    """One JSON text a run and level: metric to value (long tables stay the source of all reports)."""
    return values.groupBy("run", "level").agg(_json(_object("metric", "value")).alias("report"))


def _json(value: Column, options: dict | None = None) -> Column:
    """value as JSON; Spark writes numbers under a thousandth with an exponent (1.2E-4), and those of six digits stand here as others write them (0.00012).  Strings stay as they are."""
    def plain(part: Column) -> Column:
        for n in (4, 5, 6):
            zeros = "0." + "0" * (n - 1)
            part = F.regexp_replace(F.regexp_replace(part, rf"\b([1-9])\.0E-{n}\b", f"{zeros}$1"), rf"\b([1-9])\.([0-9]+)E-{n}\b", f"{zeros}$1$2")
        return part

    parts = F.regexp_extract_all(F.to_json(value, options or {}), F.lit(r'"(?:[^"\\]++|\\.)*+"|[^"]++'), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(plain(p))), "")


def _object(key: str, value: str):
    """An object of a group's rows, keys in order; a group's keys are a bounded set (metrics, runs, queries)."""
    return F.map_from_entries(_by_key(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value")))))


def _by_key(entries):
    """Maps have no order, so entries are compared by their keys alone."""
    return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def summary_report(means: DataFrame, context: dict) -> DataFrame:
    """report: one JSON text with the context, and for each relevance level the runs' means."""
    runs = means.groupBy("level", "run").agg(_object("metric", "value").alias("metrics"))
    return _report(runs.groupBy("level").agg(_object("run", "metrics").alias("metrics")), context)


def query_report(values: DataFrame, context: dict) -> DataFrame:
    """report: one JSON text with the context, and for each relevance level each query's values by run."""
    runs = values.withColumn("qid", F.col("qid").cast("string")).groupBy("level", "qid", "run").agg(_object("metric", "value").alias("metrics"))
    queries = runs.groupBy("level", "qid").agg(_object("run", "metrics").alias("runs"))
    return _report(queries.groupBy("level").agg(_object("qid", "runs").alias("queries")), context)


def significance_report(comparisons: DataFrame, context: dict) -> DataFrame:
    """report: one JSON text with the context, and for each relevance level "a vs b": by metric p to three digits, the better run or null, and wins, ties and losses of a."""
    counts = F.struct(F.col("wins").alias("W"), F.col("ties").alias("T"), F.col("losses").alias("L"))
    entry = F.struct(F.col("p_shown").alias("p"), "better", counts.alias("win_tie_loss"))
    named = comparisons.select("level", F.concat("run_a", F.lit(" vs "), "run_b").alias("pair"), "metric", entry.alias("entry"))
    pairs = named.groupBy("level", "pair").agg(_object("metric", "entry").alias("metrics"))
    return _report(pairs.groupBy("level").agg(_object("pair", "metrics").alias("comparisons")), context)


#: Names of the relevance passes in reports, by level.
PASSES = {1: "relevant_or_partial", 2: "relevant_only"}


def _report(levels: DataFrame, context: dict) -> DataFrame:
    name = F.element_at(F.create_map(*[F.lit(x) for kv in PASSES.items() for x in kv]), F.col("level"))
    body = [c for c in levels.columns if c != "level"]
    entries = _by_key(F.collect_list(F.struct(name.alias("key"), F.struct(F.col("level").alias("relevance_level"), *body).alias("value"))))
    fixed = [_literal(v).alias(k) for k, v in context.items()]
    whole = F.struct(*fixed, F.map_from_entries(F.col("passes")).alias("relevance_passes"))
    return levels.agg(entries.alias("passes")).select(_json(whole, {"ignoreNullFields": "false"}).alias("report"))


def _literal(v):
    if isinstance(v, dict):
        return F.create_map(*[x for k, w in v.items() for x in (F.lit(k), _literal(w))]) if v else F.create_map().cast("map<string,string>")
    if isinstance(v, (list, tuple)):
        return F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    return F.lit(v)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """set, level_name, run, level, metric, value of written summaries."""
    schema = "set string, level string, relevance_passes map<string,struct<relevance_level:int,metrics:map<string,map<string,double>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r"))
    passes = rows.select(F.col("r.set").alias("set"), F.col("r.level").alias("level_name"), F.explode("r.relevance_passes").alias("_", "p"))
    runs = passes.select("set", "level_name", F.col("p.relevance_level").alias("level"), F.explode("p.metrics").alias("run", "m"))
    return runs.select("set", "level_name", "run", "level", F.explode("m").alias("metric", "value"))


def read_significance(spark: SparkSession, path: str) -> DataFrame:
    """set, level, run_a, run_b, metric, p, better, wins, ties, losses of written significance reports; runs' names hold no " vs "."""
    entry = "struct<p:double,better:string,win_tie_loss:struct<W:long,T:long,L:long>>"
    schema = f"set string, relevance_passes map<string,struct<relevance_level:int,comparisons:map<string,map<string,{entry}>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r"))
    passes = rows.select(F.col("r.set").alias("set"), F.explode("r.relevance_passes").alias("_", "p"))
    pairs = passes.select("set", F.col("p.relevance_level").alias("level"), F.explode("p.comparisons").alias("pair", "m"))
    names = F.split("pair", " vs ")
    found = pairs.select("set", "level", names[0].alias("run_a"), names[1].alias("run_b"), F.explode("m").alias("metric", "e"))
    counts = [F.col(f"e.win_tie_loss.{k}").alias(n) for k, n in (("W", "wins"), ("T", "ties"), ("L", "losses"))]
    return found.select("set", "level", "run_a", "run_b", "metric", "e.p", "e.better", *counts)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").text(path)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """name, size and changed of each file of a table, as `signature` takes them; no column is read."""
    m = F.col("_metadata")
    return spark.read.parquet(path).select(m["file_path"].alias("name"), m["file_size"].alias("size"), m["file_modification_time"].cast("long").alias("changed")).distinct()


def index_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes under a path, from file listings; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def content_print(*columns: Column) -> Column:
    """60 bits of the SHA-256 of some columns (null as no text) with their lengths before them: sums of it tell sets of rows apart, in any order."""
    parts = [p for c in columns for t in [F.coalesce(c.cast("string"), F.lit(""))] for p in (F.octet_length(t).cast("string"), F.lit(":"), t)]
    return F.conv(F.left(F.sha2(F.concat(*parts), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")


def content_signature(rows: DataFrame, columns: list[str], settings: dict) -> DataFrame:
    """SHA-256 over a table's rows, by the given columns, and settings: the same wherever the table lies and however it is cut into files."""
    return _signed(rows, [F.col(c) for c in columns], settings)


def signature(files: DataFrame, settings: dict) -> DataFrame:
    """SHA-256 over a set of files (name, size, changed) and settings.

    The set enters as count and sum of prints: order does not matter, and rows
    aggregate where they are.
    """
    return _signed(files, [F.col(c) for c in ("name", "size", "changed")], settings)


def _signed(rows: DataFrame, columns: list[Column], settings: dict) -> DataFrame:
    folded = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(content_print(*columns)), F.lit(0)).cast("string").alias("s"))
    return folded.select(F.sha2(F.concat_ws("|", F.lit(json.dumps(settings, sort_keys=True)), F.col("n").cast("string"), "s"), 256).alias("signature"))
