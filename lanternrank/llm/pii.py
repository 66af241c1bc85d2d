"""Personal data by candidate gradient boosting: DataFrame functions only.

Generators with high recall propose spans, which may overlap: the strict forms
of each kind, loose ones (spelled-out or spaced e-mail addresses, phone numbers
without a plus, cards in any grouping, IPv6 and bracketed addresses), and
decoys, which look alike and aren't (handles, versions, other runs of digits,
dates).  Strict spans that pass their kind's check are kept as they are.  A
loose span is judged by boosted trees over format and context features: digits,
length, parts, separators, the characters around, the words before, and the
other kinds' sure spans of the document; it must pass its kind's check in its
normalised form as well.

The trees learn from spans that the strict forms tell: a valid loose span that
meets a sure span of its kind is one, decoys that meet no sure or valid span are not.
The check itself is no feature.  As the separators of these spans are mostly the strict forms' own,
each learning row counts once more with its separators hidden, and separators
that a kind's learning rows never had are hidden when they are judged.
Documents of one fold in five are kept from the trees: on these the
lower confidence bound of a kind's precision reaches `precision` from its
threshold on, which lies halfway to the next lower score, where it doesn't; a
kind without such a score, or without counterexamples among them, adds nothing.

Features are small integers, so the training set is a table of counts by
feature vector, bounded by the product of their ranges whatever the corpus
holds; only this table reaches the driver.  Trees are applied as CASE
expressions.

Defined cases: null text reads as empty; empty texts have no spans; positions
are code points, ends exclusive; repeated rows and null ids are judged row by
row; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
L = "A-Za-z0-9._%+-"
#: The strict forms; possessive and with look-behinds so that long runs cost linear time, else as the plain patterns.
STRICT = {
    "email": rf"(?:(?<![{L}])|\G)[{L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT, _AT = r"\x20?[(\[{]dot[)\]}]\x20?", r"\x20?(?:[(\[{]at[)\]}]|@)\x20?"
_LABEL = r"[A-Za-z0-9-]{2,63}+"
LOOSE = {
    "email": rf"(?<![{L}])[{L}]{{1,64}}+(?:{_AT}[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:[(\[{{]dot[)\]}}]|\.)\x20?{_LABEL})"
    rf"(?:(?:{_DOT}|\x20\.\x20|\x20?\.){_LABEL})*+"  # later labels: no space after a full stop only, which ends a sentence
    rf"|\x20at\x20{_LABEL}(?:\x20dot\x20{_LABEL})++)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
    r"|(?<![0-9A-Za-z])(?<![0-9A-Fa-f:]:)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?|(?<!:)::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?!:{0,2}[0-9A-Za-z]|::|\.[0-9])"
    r"|(?<![0-9.])[0-9]{1,3}+(?:(?:\x20?[(\[{](?:\.|dot)[)\]}]\x20?|\x20?\.\x20?)[0-9]{1,3}+){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9.])[0-9](?:[\x20._/-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20./-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9+.])0[0-9]{1,4}[\x20/-][0-9]{2,4}(?:[\x20-]?[0-9]{2,4}){1,3}(?![0-9])",
}
DECOY = {
    "email": rf"(?<![{L}])[{L}]*+@[A-Za-z0-9_-]++(?![A-Za-z0-9.@_-])",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){1,2}(?![0-9]|\.[0-9])|(?<![0-9.])[0-9]++(?:\.[0-9]++){4,}",
    "card": r"(?<![0-9])(?:[0-9]{5,11}|[0-9]{20,})(?![0-9])",
    "phone": r"(?<![0-9.+-])[0-9]{1,4}+[/-][0-9]{1,4}+(?:[/-][0-9]{1,4}+){0,2}(?![0-9-])",
}
GENERATORS = {"strict": STRICT, "loose": LOOSE, "decoy": DECOY}
#: What a match of a pattern always holds: texts without it skip the pattern.
NEEDS = {("email", "strict"): ("@",), ("email", "decoy"): ("@",), ("phone", "strict"): ("+",), ("email", "loose"): ("@", "(at)", "[at]", "{at}", " dot ")}
FEATURES = ("kind", "digits", "length", "parts", "separator", "before", "after", "word", "others")
HIDDEN = 8  # of a separator
WORDS = (r"(?i)e-?mail|contact|write", r"(?i)\bip\b|host|server|addr", r"(?i)card|visa|master|credit|pay", r"(?i)phone|tel|call|fax|mobile")
MARK = "\u0001"


def _class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^[0-9]"), 2).when(c.rlike(r"^[\p{L}]"), 3).otherwise(4)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    numbers = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(digits, i, F.lit(1)).cast("int").alias("d"), ((n - i) % 2).alias("odd")))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + F.when(x["odd"] == 1, double(x["d"])).otherwise(x["d"])) % 10 == 0


def _passes(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return s.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _normal(kind: str, s: Column) -> Column:
    """Whether a loose span passes its kind's check in its normalised form."""
    if kind == "ip":
        return F.contains(s, F.lit(":")) | _passes("ip", F.regexp_replace(s, "[^0-9]+", "."))
    return _passes(kind, s)


def _spans(kind: str, source: str, pieces: str, starts: str) -> Column:
    """Spans as structs: start, k (place of the kind), end, sure (a strict span that passes), strict, valid (a loose one that passes) and features but the last."""
    p, e = F.col(pieces), F.col(starts)

    def one(i):
        s, prior, after = F.get(p, i), F.right(F.get(p, i - 1), F.lit(24)), F.left(F.get(p, i + 1), F.lit(1))
        digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
        parts = F.least(F.regexp_count(s, F.lit(r"[0-9A-Za-z]+")), F.lit(6))
        style = sum((F.when(s.rlike(c), 1 << j).otherwise(0) for j, c in enumerate((r"\x20", "-", r"[()./_:\[\]{}]"))), F.lit(0))
        word = F.coalesce(*[F.when(prior.rlike(w), j + 1) for j, w in enumerate(WORDS)], F.lit(0))
        values = (F.lit(KINDS.index(kind)), F.least(digits, F.lit(20)), F.least(F.floor(F.length(s) / 4), F.lit(8)), parts, style, _class(F.right(prior, F.lit(1))), _class(after), word)
        named = [v.cast("int").alias(n) for v, n in zip(values, FEATURES)]
        sure = _passes(kind, s) if source == "strict" else F.lit(False)
        valid = _normal(kind, s) if source == "loose" else F.lit(False)
        return F.struct(F.get(e, i).alias("start"), F.lit(KINDS.index(kind)).alias("k"), F.get(e, i + 1).alias("end"), sure.alias("sure"), F.lit(source == "strict").alias("strict"), valid.alias("valid"), *named)

    found = F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), one)
    return F.when(F.size(p) > 2, found).otherwise(F.slice(F.transform(F.array(F.lit(1)), one), 1, 0))


def _running(values: Column) -> Column:
    """0 and the running sums."""
    return F.aggregate(values, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _blocks(pieces: str) -> Column:
    """Running sums of the pieces' lengths in blocks of about the square root of their number: n pieces cost n ** 1.5 steps."""
    n = F.size(pieces)
    width = F.ceil(F.sqrt(n)).cast("int")
    block = lambda i: _running(F.transform(F.slice(pieces, i, width), F.length))
    return F.when(n > 2, F.transform(F.sequence(F.lit(1), n, width), block)).otherwise(F.array(F.array(F.lit(0))))


def _starts(blocks: str) -> Column:
    """Where each piece starts, and where the last one ends."""
    offsets = _running(F.transform(blocks, lambda x: F.element_at(x, -1)))
    moved = F.zip_with(blocks, F.slice(offsets, 1, F.size(blocks)), lambda x, o: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: y + o))
    return F.concat(F.flatten(moved), F.array(F.element_at(offsets, -1)))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, fold, candidates (the strict and loose spans that the generators propose) and told.

    A pattern's matches are set between marks and the text is split at them, so
    that odd pieces are matches and lengths give positions.  told holds the
    loose spans and decoys of which the strict forms tell what they are: y.
    """
    rows = docs.select("doc_id", common.doc_hash_mod("doc_id", 5).cast("int").alias("fold"), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit("\u0002")).alias("_t"))
    rows = rows.select("*", F.col("_t").rlike("[0-9][^A-Za-z]{0,3}[0-9]").alias("_digits"))
    names = [(kind, source, f"_p{source}{kind}", f"_s{source}{kind}") for kind in KINDS for source in GENERATORS]

    def split(kind, source):
        marked = F.split(F.regexp_replace("_t", GENERATORS[source][kind], f"{MARK}$0{MARK}"), MARK)
        if needs := NEEDS.get((kind, source)):
            may = reduce(lambda a, b: a | b, [F.contains("_t", F.lit(x)) for x in needs])
        else:
            may = F.col("_digits") | (F.contains("_t", F.lit(":")) if (kind, source) == ("ip", "loose") else F.lit(False))
        return F.when(may, marked).otherwise(F.array(F.lit("")))

    rows = rows.select("doc_id", "fold", *[split(kind, source).alias(p) for kind, source, p, _ in names])
    rows = rows.select("*", *[_blocks(p).alias(f"_b{s}") for _, _, p, s in names])
    rows = rows.select("*", *[_starts(f"_b{s}").alias(s) for _, _, _, s in names])
    rows = rows.select("doc_id", "fold", *[_spans(*n).alias(f"{n[1]}{n[0]}") for n in names])
    rows = rows.select("*", *[F.filter(f"strict{kind}", lambda c: c["sure"]).alias(f"sure{kind}") for kind in KINDS], *[F.filter(f"loose{kind}", lambda c: c["valid"]).alias(f"valid{kind}") for kind in KINDS])

    def full(kind, source, y=None):
        others = F.least(sum((F.size(f"sure{o}") for o in KINDS if o != kind), F.lit(0)), F.lit(3)).cast("int")
        return F.transform(f"{source}{kind}", lambda c: c.withField("others", others) if y is None else c.withField("others", others).withField("y", y(c)))

    def told(kind, source):
        if source == "loose":
            return full(kind, source, lambda c: F.when(c["valid"] & _touches(f"sure{kind}", c), 1).cast("int"))
        return full(kind, source, lambda c: F.when(~reduce(lambda a, b: a | b, [_touches(f"{name}{o}", c) for o in KINDS for name in ("sure", "valid")]), 0).cast("int"))

    proposed = [full(kind, source) if source == "strict" else F.filter(full(kind, source), lambda c: c["valid"]) for kind, source, _, _ in names if source != "decoy"]
    tells = F.filter(F.concat(*[told(kind, source) for kind, source, _, _ in names if source != "strict"]), lambda c: F.isnotnull(c["y"]))
    return rows.select("doc_id", "fold", F.concat(*proposed).alias("candidates"), tells.alias("told"))


# ---- boosted trees on counts by feature vector

def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3) -> list:
    """Trees as nested (feature, threshold, left, right) or leaf values; logistic loss, Newton leaves."""
    score, trees = np.zeros(len(y)), []

    def grow(rows, g, h, left):
        leaf = float(-rate * g[rows].sum() / (h[rows].sum() + 1))
        if not left:
            return leaf
        gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
        best = (1e-3, None)
        for f in range(x.shape[1]):
            for t in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= t
                got = gain(rows[low]) + gain(rows[~low]) - gain(rows)
                if got > best[0] + 1e-9:
                    best = (got, (f, int(t), low))
        if best[1] is None:
            return leaf
        f, t, low = best[1]
        return f, t, grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), w * (p - y), w * p * (1 - p), depth)
        trees.append(tree)
        score += apply(tree, x)
    return trees


def apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, apply(a, x), apply(b, x))


def _expr(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, t, a, b = tree
    return F.when(c[FEATURES[f]] <= t, _expr(a, c)).otherwise(_expr(b, c))


def table(found: DataFrame) -> list[tuple]:
    """Counts of told spans: features, y, whether the document is of the kept fold, and the count."""
    c = F.col("c")
    told = found.select("fold", F.explode("told").alias("c"))
    return sorted(tuple(r) for r in told.groupBy(*[c[f].alias(f) for f in FEATURES], c.y.alias("y"), (F.col("fold") == 0).alias("kept")).agg(F.count("*").alias("n")).collect())


def hidden(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[:, FEATURES.index("separator")] = HIDDEN
    return out


def bound(good: float, total: float, z: float = 1.0) -> float:
    """Wilson's lower confidence bound of a share."""
    p = good / total
    return (p + z * z / (2 * total) - z * ((p * (1 - p) + z * z / (4 * total)) / total) ** 0.5) / (1 + z * z / total)


def learn(counts: list[tuple], precision: float = 0.9) -> tuple[list, list[float], list[set[int]]]:
    """Trees, each kind's threshold on their sum (infinite: adds nothing), and the separators that its learning rows had."""
    data = np.array([[*map(int, r[:-1]), r[-1]] for r in counts]).reshape(-1, len(FEATURES) + 3)
    x, y, kept, n = data[:, : len(FEATURES)], data[:, -3], data[:, -2] == 1, data[:, -1].astype(float)
    seen = [set(x[(x[:, 0] == k) & ~kept, FEATURES.index("separator")].tolist()) for k in range(len(KINDS))]
    if not (~kept).any():
        return [], [float("inf")] * len(KINDS), seen
    w = n[~kept]
    for k in range(len(KINDS)):  # each kind counts the same, and so do its two sides
        for side in (0, 1):
            mine = (x[~kept, 0] == k) & (y[~kept] == side)
            w[mine] *= len(w) / max(1.0, w[mine].sum())
    both = np.concatenate((x[~kept], hidden(x[~kept])))
    trees = boost(both, np.tile(y[~kept], 2).astype(float), np.tile(w / w.mean(), 2))
    score, limits = sum(apply(t, x) for t in trees), []
    for k in range(len(KINDS)):
        mine = np.flatnonzero(kept & (x[:, 0] == k))
        limit = float("inf")
        found = sorted(set(score[mine]), reverse=True) if (y[mine] == 0).any() else []  # without a counterexample nothing is measured
        for t, below in zip(found, [*found[1:], None]):
            at = mine[score[mine] >= t - 1e-9]
            if bound((n[at] * y[at]).sum(), n[at].sum()) >= precision:  # halfway to what would fail; a half, where nothing does
                limit = float(min(t, 0.0) if below is None else (t + below) / 2)
        limits.append(limit)
    return trees, limits, seen


def find(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """doc_id, base and spans: arrays of structs (start, k, end), sorted; spans holds base and what the trees add."""
    found = common.written(candidates(docs), "candidates")
    return choose(found, *learn(table(found), precision))


def choose(found: DataFrame, trees: list, limits: list[float], seen: list[set[int]] | None = None) -> DataFrame:
    """What `find` returns, from candidates: of loose spans that overlap, the likelier, then the longer, then the first stays.

    Only loose spans of different kinds that overlap each other are weighed one
    by one, which costs the square of their number in a text; all others cost
    a binary search each.
    """
    bare = lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"))
    limit = lambda c: F.element_at(F.array(*[F.lit(x) for x in limits]), c["k"] + 1)
    total = lambda c: sum((_expr(t, c) for t in trees), F.lit(0.0))
    known = lambda c: reduce(lambda a, b: a | b, [(c["k"] == k) & c["separator"].isin(sorted(s)) for k, s in enumerate(seen)])
    shown = lambda c: c if seen is None else c.withField("separator", F.when(known(c), c["separator"]).otherwise(HIDDEN))
    loose = F.filter("candidates", lambda c: ~c["strict"])
    scored = F.transform(F.transform(loose, shown), lambda c: F.struct((-total(c)).alias("cost"), (c["start"] - c["end"]).alias("short"), c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"), limit(c).alias("limit")))
    likely = F.filter(scored, lambda c: -c["cost"] >= c["limit"])
    kinds = range(len(KINDS))
    sure = [F.transform(F.filter(F.filter("candidates", lambda c: c["sure"]), _of_kind(k)), bare).alias(f"b{k}") for k in kinds]
    rows = found.select("doc_id", *sure, likely.alias("likely"))
    clear = F.filter("likely", lambda c: ~reduce(lambda a, b: a | b, [_touches(f"b{k}", c) for k in kinds]))
    rows = rows.select("doc_id", F.array_sort(F.concat(*[f"b{k}" for k in kinds])).alias("base"), clear.alias("clear"))
    rows = rows.select("*", *[F.filter("clear", _of_kind(k)).alias(f"l{k}") for k in kinds])
    # spans of one generator never overlap: only those that meet another kind's have to be weighed against each other
    rivals = lambda c: reduce(lambda a, b: a | b, [(c["k"] != k) & _touches(f"l{k}", c) for k in kinds])
    contested = F.array_sort(F.filter("clear", rivals))
    rows = rows.select("doc_id", "base", F.transform(F.filter("clear", lambda c: ~rivals(c)), bare).alias("alone"), contested.alias("contested"))
    apart = lambda a, c: ~F.exists(a, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]))
    won = F.aggregate("contested", F.slice("base", 1, 0), lambda a, c: F.when(apart(a, c), F.concat(a, F.array(bare(c)))).otherwise(a))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "alone", won)).alias("spans"))


def _touches(spans: str, c: Column) -> Column:
    """Whether one of the spans, in order and without overlaps, overlaps c: a binary search for the last that starts before c ends."""
    n = F.size(spans)

    def halve(s, _):
        middle = F.shiftright(s["low"] + s["high"], 1)
        before = F.coalesce(F.get(spans, middle)["start"] < c["end"], F.lit(False))
        return F.struct(F.when(before, middle + 1).otherwise(s["low"]).alias("low"), F.when(before, s["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int")), F.struct(F.lit(0).alias("low"), n.alias("high")), halve)
    return F.when(n > 0, F.coalesce(F.get(spans, found["low"] - 1)["end"] > c["start"], F.lit(False))).otherwise(False)


def _of_kind(k: int):
    return lambda c: c["k"] == k


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["k"] + 1), c["start"].cast("string"), c["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans and n_added of every document."""
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    more = [F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added")]
    return find(docs).select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *more)
