"""URL filter by a path-template tree.

Rules (a host with its subdomains, and a path prefix) decide first; their
verdicts also label URLs.  For each host a tree of path segments is built from
the root down.  Segments with a variable form become wildcards.  Branches of a
node are alike if most of their pages go on in the same form (the same number
of segments, with wildcards and words at the same places): these are merged
into a wildcard ``*``, unless a branch's share of blocked labels differs
significantly from that of the others alike.  Branches without labels go into a
wildcard of their own, ``?``: nothing is known of them, and a section's labels
say nothing of its neighbours.  Only where enough labelled siblings of their
form agree with each other, and none stands apart, do they go with these: three
if the form has several segments, eight if it is a bare word or number (smoothed
shares of agreeing branches of 4/5 and 9/10).  Deeper nodes are built on merged
prefixes.  What remains are templates; a template is blocked if the smoothed
share of blocked labels, (blocked + 1) / (labelled + 2), reaches `purity`.
Templates without labels so stay allowed, and no number of pages is a switch.

The tree is a table of nodes; every step is an aggregation or a join by node (a
hash of its names), so a host that holds a third of all pages is spread over
its paths, and long paths cost what they hold: no prefix is built as a string.

Defined cases: a null url or one without `://` has an empty host and path and
is allowed; the empty path is a template of its own; repeated rows are judged
alike; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path): the rules of the query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Agreeing labelled branches that unlabelled siblings go with, by whether their form has several segments.
AGREE, AGREE_BARE = 3, 8
VARIABLE = r"[0-9]+|(?=[A-Za-z0-9_-]{8})[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return common.ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def ruled(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its verdict; null where none does."""
    cases = []
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        cases.append((fits, host + path, verdict))
    return tuple(F.coalesce(*[F.when(c[0], F.lit(c[i])) for c in cases], F.lit(None).cast("string")) for i in (1, 2))


def _segments(path: Column) -> Column:
    """Non-empty segments, those of a variable form as a wildcard that keeps a file's extension."""
    stem = lambda s: F.regexp_replace(s, rf"^(?:{VARIABLE})(\.[A-Za-z]+)?$", "*$1")
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), stem)


def _shared(a: Column, b: Column) -> Column:
    """How many first elements two arrays have in common."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(n).cast("int")


def _tail(a: Column, n: Column | int) -> Column:
    """The array without its first n elements."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def merges(shapes: DataFrame, z: float = 2.0) -> DataFrame:
    """row, depth and name of each segment that becomes a wildcard because its branch is merged with siblings.

    shapes: row, host, segments, pages, blocked, allowed; one row a distinct
    host and segments.  A round takes each open node to the depth where its
    paths part, names the branches there and opens the merged nodes; so the
    rounds are as many as the branchings of a path, not its segments.
    """
    key = ["host", "node"]
    form = lambda s: F.when(F.startswith(s, F.lit("*")), s).otherwise("w")
    open_ = shapes.select("row", "host", F.lit(0).cast("long").alias("node"), F.lit(0).alias("depth"), F.col("segments").alias("rest"), F.transform("segments", form).alias("forms"), "pages", "blocked", "allowed")
    found = None
    while True:
        parting = open_.groupBy(*key).agg(F.count("*").alias("n"), F.min("rest").alias("low"), F.max("rest").alias("high")).where("n > 1").select(*key, _shared(F.col("low"), F.col("high")).alias("same"))
        at = open_.join(parting, key).withColumns({"rest": _tail(F.col("rest"), F.col("same")), "forms": _tail(F.col("forms"), F.col("same")), "depth": F.col("depth") + F.col("same")}).where("size(rest) > 0")
        at = common.written(at.drop("same").withColumns({"segment": F.get("rest", F.lit(0)), "form": F.array_join(_tail(F.col("forms"), 1), "/")}), "branches")
        if at.isEmpty():
            break
        by_form = at.groupBy(*key, "segment", "form").agg(*[F.sum(c).alias(c) for c in ("pages", "blocked", "allowed")])
        child = by_form.groupBy(*key, "segment").agg(F.max(F.struct("pages", "form")).alias("mode"), F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).withColumn("mode", F.col("mode.form"))
        group = child.groupBy(*key, "mode").agg(F.sum("b").alias("all_b"), F.sum("a").alias("all_a"))
        n, rest = F.col("a") + F.col("b"), F.col("all_a") + F.col("all_b") - F.col("a") - F.col("b")
        pooled = F.col("all_b") / (n + rest)
        apart = F.abs(F.col("b") / n - (F.col("all_b") - F.col("b")) / rest)
        alike = F.when(n == 0, None).when(rest > 0, apart <= z * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / rest))).otherwise(True)
        tested = child.join(group, [*key, "mode"]).withColumn("alike", alike)
        told = tested.groupBy(*key, "mode").agg(F.count_if("alike").alias("told"), F.count_if(~F.col("alike")).alias("odd"), F.count_if(F.isnull("alike")).alias("silent"))
        joins = (F.col("odd") == 0) & (F.col("told") >= F.when(F.contains("mode", F.lit("/")), AGREE).otherwise(AGREE_BARE))
        merged = F.when(F.col("alike") & (F.col("told") > 1) | F.isnull("alike") & joins, "*").when(F.isnull("alike") & (F.col("silent") > 1), "?").otherwise(F.col("segment"))
        named = tested.join(told, [*key, "mode"]).select(*key, "segment", merged.alias("name"))
        steps = common.written(at.join(named, [*key, "segment"]), "steps")
        changed = steps.where("name <> segment").select("row", "depth", "name")
        found = changed if found is None else found.unionByName(changed)
        open_ = steps.select("row", "host", F.xxhash64("node", "depth", "name").alias("node"), (F.col("depth") + 1).alias("depth"), _tail(F.col("rest"), 1).alias("rest"), _tail(F.col("forms"), 1).alias("forms"), "pages", "blocked", "allowed")
    return shapes.select("row", F.lit(0).alias("depth"), F.lit("").alias("name")).limit(0) if found is None else found


def templates(labelled: DataFrame, z: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(host, path, template) of each distinct path, and (host, template, blocked, allowed).

    labelled: host, path, pages, blocked, allowed (counts), one row a distinct path.
    """
    paths = labelled.withColumn("segments", _segments(F.col("path")))
    counts = [F.sum(c).alias(c) for c in ("pages", "blocked", "allowed")]
    shapes = common.written(paths.groupBy("host", "segments").agg(*counts).withColumn("row", F.monotonically_increasing_id()), "shapes")
    stars = merges(shapes, z).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("depth", "name"))).alias("stars"))
    star = lambda s, i: F.coalesce(F.try_element_at("stars", i), s)
    full = shapes.join(stars, "row", "left").select("host", "segments", F.array_join(F.when(F.isnull("stars"), F.col("segments")).otherwise(F.transform("segments", star)), "/").alias("template"))
    known = paths.select("host", "path", "segments", "blocked", "allowed").join(full, ["host", "segments"])
    known = common.written(known.drop("segments"), "templates")
    return known.select("host", "path", "template"), known.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, purity: float = 0.8, z: float = 2.0, shown: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, template, purity (smoothed, of the template), method (its verdict) and verdict of every page.

    shown: which pages' rule verdicts the tree may learn from; all by default.
    """
    host, path = split_url(F.col("url"))
    rule, verdict = ruled(rules)
    label = F.lit(True) if shown is None else F.coalesce(shown, F.lit(False))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), label.alias("shown")).withColumns({"rule": rule, "given": verdict})
    tally = lambda v: F.count(F.when((F.col("given") == v) & F.col("shown"), 1))
    labelled = split.groupBy("host", "path").agg(F.count("*").alias("pages"), tally("block").alias("blocked"), tally("allow").alias("allowed"))
    named, counts = templates(labelled, z)
    share = (F.col("blocked") + 1) / (F.col("blocked") + F.col("allowed") + 2)
    judged = counts.select("host", "template", share.alias("purity"), F.when(share >= purity, "block").otherwise("allow").alias("method"))
    known = split.join(named.join(judged, ["host", "template"]), ["host", "path"])
    return known.select("page_id", "host", "path", "rule", "template", "purity", "method", F.coalesce("given", "method").alias("verdict"))


def _sql_case(rules: list[tuple[str, str, str]], result) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{result(v, h, p)}'" for v, h, p in ordered) + " END"


SQL = rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{common.UPPER}', '{common.LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), split AS (
  SELECT *, {_sql_case(RULES, lambda v, h, p: h + p)} AS rule, {_sql_case(RULES, lambda v, h, p: v)} AS given FROM parts
), labelled AS (
  SELECT host, path, count(*) AS pages, count(*) FILTER (given = 'block') AS blocked, count(*) FILTER (given = 'allow') AS allowed,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE
      WHEN regexp_full_match(s, '[0-9]+(\.[A-Za-z]+)?') OR regexp_full_match(s, '[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*(\.[A-Za-z]+)?') AND length(regexp_extract(s, '^[0-9a-fA-F-]*')) >= 8
      THEN '*' || regexp_extract(s, '\.[A-Za-z]+$') ELSE s END) AS segments
  FROM split GROUP BY host, path
), shapes AS (SELECT host, segments, sum(pages)::BIGINT AS pages, sum(blocked)::BIGINT AS blocked, sum(allowed)::BIGINT AS allowed FROM labelled GROUP BY ALL),
walk(host, segments, pages, blocked, allowed, names) AS (
  SELECT *, []::VARCHAR[] FROM shapes
  UNION ALL
  SELECT host, segments, pages, blocked, allowed, list_append(names, CASE
    WHEN alike AND told > 1 OR alike IS NULL AND odd = 0 AND told >= CASE WHEN contains(form_of, '/') THEN 3 ELSE 8 END THEN '*' WHEN alike IS NULL AND silent > 1 THEN '?' ELSE segment END)
  FROM (
    SELECT *, count(DISTINCT CASE WHEN alike THEN segment END) OVER same AS told, count(DISTINCT CASE WHEN NOT alike THEN segment END) OVER same AS odd, count(DISTINCT CASE WHEN alike IS NULL THEN segment END) OVER same AS silent FROM (
      SELECT *, CASE WHEN n = 0 THEN NULL WHEN rest = 0 THEN true ELSE abs(b / n - (all_b - b) / rest) <= 2 * sqrt((all_b / (n + rest)) * (1 - all_b / (n + rest)) * (1 / n + 1 / rest)) END AS alike FROM (
        SELECT *, a + b AS n, all_a + all_b - a - b AS rest FROM (
          SELECT *, sum(blocked) OVER alike AS all_b, sum(allowed) OVER alike AS all_a FROM (
            SELECT *, mode.f AS form_of FROM (
              SELECT *, max(struct_pack(p := form_pages, f := form)) OVER branch AS mode, sum(blocked) OVER branch AS b, sum(allowed) OVER branch AS a FROM (
                SELECT *, sum(pages) OVER (PARTITION BY host, names, segment, form) AS form_pages FROM (
                  SELECT *, segments[len(names) + 1] AS segment, array_to_string(list_transform(segments[len(names) + 2:], lambda s: CASE WHEN starts_with(s, '*') THEN s ELSE 'w' END), '/') AS form
                  FROM walk WHERE len(names) < len(segments)
                )
              ) WINDOW branch AS (PARTITION BY host, names, segment)
            )
          ) WINDOW alike AS (PARTITION BY host, names, form_of)
        )
      )
    ) WINDOW same AS (PARTITION BY host, names, form_of)
  )
), shaped AS (SELECT host, segments, array_to_string(names, '/') AS template FROM walk WHERE len(names) = len(segments)),
known AS (SELECT l.host, path, blocked, allowed, template FROM labelled l JOIN shaped s ON s.host = l.host AND s.segments = l.segments),
judged AS (SELECT host, template, (sum(blocked) + 1) / (sum(blocked) + sum(allowed) + 2) AS purity FROM known GROUP BY ALL)
SELECT page_id, s.host, s.path, rule, k.template, purity, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END AS method,
  coalesce(given, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict
FROM split s JOIN known k ON k.host = s.host AND k.path = s.path JOIN judged j ON j.host = k.host AND j.template = k.template
"""
