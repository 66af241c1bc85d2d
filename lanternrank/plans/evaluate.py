"""Evaluations: named systems over query sets and levels, their runs, latencies, metrics, comparisons and reports."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternrank.operators import blocks as B
from lanternrank.operators import metrics as M
from lanternrank.sources import corpus as C
from lanternrank.sources import workspace

LEVELS = ("paper", "paragraph")


@dataclass(frozen=True)
class Settings:
    metrics: tuple[str, ...] = M.METRICS
    strict_metrics: tuple[str, ...] = ("mrr", "p5")
    max_p: float = 0.05
    k: int = 100
    levels: tuple[str, ...] = LEVELS
    team: str = "team"
    stem: bool = True
    limit: int | None = None

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k is 1 at least")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit is 1 at least")
        if unknown := {*self.metrics, *self.strict_metrics} - set(M.METRICS):
            raise ValueError(f"unknown metrics: {sorted(unknown)}")
        if not self.metrics and not self.strict_metrics:
            raise ValueError("no metrics are asked for")
        if not self.levels or set(self.levels) - set(LEVELS):
            raise ValueError(f"levels are of {LEVELS}")


def settings_of(config: dict) -> tuple[Settings, list[tuple[str, bool]]]:
    """Settings, and (name, whether it is measured) of each query set, from a configuration as a file of settings gives it."""
    if not config.get("models") or not config.get("sets"):
        raise ValueError("a configuration names models and query sets")
    names = {"metrics": "metrics", "strict_metrics": "strict_metrics", "max_p": "max_p", "k": "k", "levels": "levels", "team_name": "team", "stem": "stem", "limit": "limit"}
    given = {names[k]: tuple(v) if isinstance(v, list) else v for k, v in config.items() if k in names}
    for name, model in config["models"].items():
        kind = (model or {}).get("type", "sparse")
        if kind not in ("sparse", "dense"):
            raise ValueError(f"{name}: unknown model type {kind!r}")
        if kind == "dense" and model.get("level") not in given.get("levels", LEVELS):
            raise ValueError(f"{name}: a dense model names one of the levels")
    return Settings(**given), [(s["name"], bool(s["metrics"])) for s in config["sets"]]


@dataclass
class Report:
    values: DataFrame  # run, qid, metric, value, level
    means: DataFrame  # run, level, metric, value
    comparisons: DataFrame  # level, metric, run_a, run_b, ...


def evaluate(runs: DataFrame, qrels: DataFrame, settings: Settings = Settings(), order: tuple[str, ...] = ()) -> Report:
    """Per-query values (a written table: queries times runs times metrics), means and comparisons; `order` tells which of two runs comes first."""
    kept = runs.where(F.col("rank") <= settings.k)
    values = workspace.written(M.passes(kept, qrels, settings.metrics, settings.strict_metrics), "values")
    means = values.groupBy("run", "level", "metric").agg(F.avg("value").alias("value"))
    return Report(values, means, M.compared(values, ("level", "metric"), settings.max_p, order=order))


@dataclass(frozen=True)
class System:
    """A named system: `search(topics, level, k)` gives qid, docid (papers: paper_id), score and rank.

    on_test: whether sets that aren't measured are searched; save: whether its
    runs are written; experimental systems are measured but never written.
    check raises if its index isn't whole; size gives files and bytes of a level;
    index is what tells the time of each query, if it searches one.
    """

    name: str
    search: Callable[[DataFrame, str, int], DataFrame]
    levels: tuple[str, ...] = LEVELS
    on_test: bool = False
    save: str | None = None
    experimental: bool = False
    check: Callable[[], None] | None = None
    size: Callable[[str], DataFrame] | None = None
    index: object | None = None


def finished_run(name: str, run: DataFrame, level: str, save: str | None = None) -> System:
    """A system whose ranking (qid, docid, score, rank) was made elsewhere, such as a baseline's file."""
    def search(topics, _, k):
        asked = topics.select(F.col("qid").cast("string").alias("qid")).distinct()
        return run.where(F.col("rank") <= k).withColumn("qid", F.col("qid").cast("string")).join(asked, "qid", "left_semi").select("qid", "docid", "score", "rank")

    return System(name, search, (level,), on_test=True, save=save)


@dataclass(frozen=True)
class Model:
    """What a configured model searches with.

    index: a SparseIndex or a DenseIndex; encode: topics to the queries that it
    searches (sparse: qid, term, weight; dense: qid, vector); papers: how many
    the corpus has, against which a sparse index is checked; scorer and texts: what reranking takes.
    """

    index: object
    encode: Callable[[DataFrame], DataFrame]
    papers: int | None = None
    scorer: Callable | None = None
    texts: DataFrame | None = None


#: Names of dense methods in configurations, by level.
METHODS = {
    "paragraph": {"cosine_similarity": "cosine", "crossencoder": "crossencoder"},
    "paper": {"from_paragraphs": "cosine", "mean_pooling": "mean", "crossencoder": "crossencoder"},
}


def systems_of(config: dict, models: dict[str, Model]) -> list[System]:
    """The systems of a configuration's models.

    A sparse model searches paragraphs, and papers by their best passage; its
    pooled papers are an experimental system of their own.  A dense model
    searches its level by its method.
    """
    settings, _ = settings_of(config)
    out = []
    for name, spec in config["models"].items():
        spec = spec or {}
        if name not in models:
            raise ValueError(f"{name}: no such model")
        m, more = models[name], {"on_test": bool(spec.get("do_test")), "save": spec.get("save_id")}
        more["index"] = m.index
        if spec.get("type", "sparse") == "sparse":
            more["size"] = m.index.size

            def check(m=m):
                m.index.check("paragraph", papers=m.papers)

            def words(topics, level, k, m=m, strategy="maxp"):
                return m.index.search(topics, m.encode(topics), level, strategy, k)

            out.append(System(name, words, settings.levels, check=check, **more))
            if "paper" in settings.levels:
                out.append(System(f"{name}-pool", lambda topics, level, k, f=words: f(topics, level, k, strategy="pool"), ("paper",), experimental=True, size=m.index.size, index=m.index))
            continue
        level = spec["level"]
        if (said := spec.get(f"{level}_method", "cosine_similarity" if level == "paragraph" else "from_paragraphs")) not in METHODS[level]:
            raise ValueError(f"{name}: unknown {level} method {said!r}")

        def near(topics, level, k, m=m, method=METHODS[level][said]):
            return m.index.search(m.encode(topics), level, method, k, m.scorer, m.texts, topics)

        out.append(System(name, near, (level,), check=m.index.check, **more))
    return out


@dataclass(frozen=True)
class QuerySet:
    """topics: qid and query, and their ordinal where the file's order counts; qrels by level for a set that is measured."""

    name: str
    topics: DataFrame
    qrels: dict[str, DataFrame] | None = None

    def first(self, limit: int | None) -> QuerySet:
        """The first topics, by ordinal if there is one and else by id; judgments are asked of these alone."""
        if limit is None:
            return self
        by = ["ordinal"] if "ordinal" in self.topics.columns else ["qid"]
        return QuerySet(self.name, self.topics.orderBy(*by).limit(limit), self.qrels)


@dataclass
class Outcome:
    runs: DataFrame  # set, level, run, qid, docid, score, rank
    latency: DataFrame  # set, level, method, qid, ms, cold_ms
    reports: dict[tuple[str, str], Report] = field(default_factory=dict)
    texts: dict[tuple[str, str, str], DataFrame] = field(default_factory=dict)  # (set, level, summary or queries or significance): report


LATENCY = "set string, level string, method string, qid string, ms double, cold_ms double"


def _times(seconds: dict, qids: list, wall: float) -> list[tuple]:
    """(id, ms, cold ms) of each query: the job's time, split by the seconds that its tasks took for each; in equal shares if they didn't tell."""
    every = sum(s for s, _ in seconds.values())
    if not every:
        return [(str(q), wall / max(1, len(qids)), 0.0) for q in qids]
    return [(str(q), wall * s / every, wall * cold / every) for q in qids for s, cold in [seconds.get(q, (0.0, 0.0))]]


def run_evaluation(spark: SparkSession, systems: list[System], sets: list[QuerySet], settings: Settings = Settings(), folder: str | None = None, prior: str | None = None) -> Outcome:
    """Searches every set at every level with every system that takes part, and measures the sets that have judgments.

    Each search is one job over all topics of the set.  A query's latency is the
    part of the job's time that its tasks took for it, and of that what their
    cold first steps took; where a system's index doesn't tell, an equal share.
    Runs, their lines, latencies and the three reports of each set and level are
    written under `folder`.  prior: the folder of an earlier evaluation, whose
    latencies stand for the methods that this one doesn't run.
    """
    if not systems or not sets:
        raise ValueError("an evaluation needs systems and query sets")
    if len({s.name for s in systems}) < len(systems):
        raise ValueError("two systems have one name")
    for q in sets:
        if q.qrels is not None and (missing := set(settings.levels) - set(q.qrels)):
            raise ValueError(f"{q.name} lacks judgments of {sorted(missing)}")
    for s in systems:
        if wrong := set(s.levels) - set(LEVELS):
            raise ValueError(f"{s.name}: unknown levels {sorted(wrong)}")
        if s.check:
            s.check()
    sets = [q.first(settings.limit) for q in sets]
    folder = folder or f"{workspace.shared_dir(spark)}/evaluation-{time.time_ns()}"
    times = []
    for s in systems:
        for q in sets:
            if q.qrels is None and not s.on_test:
                continue
            for level in (x for x in settings.levels if x in s.levels):
                began = time.perf_counter()
                met = B.Met(spark) if s.index is not None else None
                if met:
                    s.index.met = met
                found = s.search(q.topics, level, settings.k)
                item = "docid" if "docid" in found.columns and level == "paragraph" else "paper_id"
                found.select(F.lit(s.name).alias("run"), F.col("qid").cast("string").alias("qid"), F.col(item).alias("docid"), "score", "rank").write.mode("overwrite").parquet(f"{folder}/runs/set={q.name}/level={level}/method={s.name}")
                wall = 1000 * (time.perf_counter() - began)
                qids = [r.qid for r in q.topics.select("qid").distinct().collect()]  # a bounded set
                times += [(q.name, level, s.name, *t) for t in _times(met.seconds() if met else {}, qids, wall)]
    schema = "run string, qid string, docid string, score double, rank int, set string, level string, method string"
    runs = spark.read.schema(schema).parquet(f"{folder}/runs") if times else spark.createDataFrame([], schema)
    latency = spark.createDataFrame(times, LATENCY)
    if prior:
        old = spark.read.schema(LATENCY).parquet(f"{prior}/latency")
        latency = latency.unionByName(old.join(latency.select("set", "level", "method").distinct(), ["set", "level", "method"], "left_anti"))
    latency.coalesce(1).write.mode("overwrite").parquet(f"{folder}/latency")
    out = Outcome(runs, spark.read.schema(LATENCY).parquet(f"{folder}/latency"))
    order = tuple(s.name for s in systems)
    for q in sets:
        for level in settings.levels:
            here = runs.where((F.col("set") == q.name) & (F.col("level") == level)).select("run", "qid", "docid", "score", "rank")
            paths = {}
            for s in systems:
                if s.save and not s.experimental and level in s.levels and (q.qrels is not None or s.on_test):
                    paths[s.name] = C.run_path(f"{folder}/trec", settings.team, level, s.save, q.name, settings.stem)
                    C.write_run(here.where(F.col("run") == s.name), paths[s.name])
            if q.qrels is not None:
                judged = q.qrels[level].withColumn("qid", F.col("qid").cast("string"))
                asked = q.topics.select(F.col("qid").cast("string").alias("qid"), "query")
                report = evaluate(here, C.asked(judged, asked), settings, order)
                out.reports[q.name, level] = report
                _write_reports(out, systems, settings, q.name, level, paths, folder)
    return out


def _write_reports(out: Outcome, systems: list[System], settings: Settings, set_: str, level: str, paths: dict[str, str], folder: str) -> None:
    report, context = out.reports[set_, level], {"set": set_, "level": level, "stem": settings.stem, "k": settings.k}
    sizes = {s.name: s.size(level).first() for s in systems if s.size and level in s.levels}
    steady = {r.method: r.mean_ms for r in steady_mean(out.latency.where((F.col("set") == set_) & (F.col("level") == level))).collect()}
    means, values = report.means, report.values
    more = {
        "index_bytes": {name: r.bytes or 0 for name, r in sizes.items()}, "mean_latency_ms": steady, "trec_runs": paths,
        "experimental_methods": [s.name for s in systems if s.experimental and level in s.levels],
    }
    texts = {"summary": C.summary_report(means, context | more), "queries": C.query_report(values, context)}
    if len([s for s in systems if level in s.levels]) > 1:  # nothing to compare a single run with
        texts["significance"] = C.significance_report(report.comparisons, context | {"stat_test": "student", "max_p": settings.max_p})
    for name, text in texts.items():
        out.texts[set_, level, name] = text
        C.write_report(text, f"{folder}/reports/{set_}_{level}_{name}")


def carried_forward(new: DataFrame, old: DataFrame, key: str = "method", value: str = "ms") -> DataFrame:
    """Every key of the old report, with the new value where there is one; new keys are added."""
    n = new.withColumnRenamed(value, "_new")
    return old.join(n, key, "full_outer").select(key, F.coalesce("_new", value).alias(value))


def merged(reports: DataFrame, key: tuple[str, ...], order: str, value: str) -> DataFrame:
    """The value of the last report for each key."""
    return reports.groupBy(*key).agg(F.max_by(value, order).alias(value))


def loss_curves(history: DataFrame) -> DataFrame:
    """model, epoch, part (train_loss or val_loss) and loss: a row a point of the curves."""
    return history.unpivot(["model", "epoch"], ["train_loss", "val_loss"], "part", "loss")


def steady_mean(latency: DataFrame) -> DataFrame:
    """Mean latency of each method without its first query.

    The first is the one of the smallest id, so sums suffice and no group is sorted.
    """
    first = F.min_by("ms", "qid")
    sums = latency.groupBy("method").agg(F.sum("ms").alias("s"), F.count("*").alias("n"), first.alias("first"))
    return sums.where("n > 1").select("method", ((F.col("s") - F.col("first")) / (F.col("n") - 1)).alias("mean_ms"))
