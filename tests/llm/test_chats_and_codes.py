"""Conversation repair, chat formatting and vector codes against plain definitions of them."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternrank.llm import chat, codes, queries, turns

DIR = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def chats(spark):
    """Nulls in every column, blank, long and repeated texts, equal turns and rows, odd roles, and columns named like results."""
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi there"), (1, 2, "assistant", "Yes?"), (1, 2, "assistant", "Yes?"), (1, 2, "assistant", "Ah."), (1, None, "user", "Before."), (1, 9, "tool", "x!"),
        (2, 0, None, None), (2, None, None, "no role."), (2, None, None, "no role."), (2, 5, "", "  \n"), (None, 0, "user", "a </turn> b ### c \\"), (None, None, "assistant", "\\\\### </turn>\n</turn>\n### user:\n"),
        (3, 0, "a:\nb\\", "### x:\n\\"), (3, 1, "user\n", "é ü 漢字"), (4, 1, "user", "lorem ipsum. " * 30_000), (4, 2, "assistant", "###" * 5), (5, 3, "assistant", "only."), (6, 0, "user", ""), (7, 4, "system", "S."), (7, 4, "system", "T."),
    ]
    df = spark.createDataFrame(rows, ROWS)
    return df.withColumns({n: F.lit("clash") for n in ("message", "seq", "kind", "fault", "step", "edit", "cost", "plan", "f", "copy", "held", "turns")}).repartition(3)


# ---- conversation repair

def faults_of(rows):
    """(role, text, fault) of a conversation's rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by searching all edits, cheapest and then ASCII-least first."""
    accepts, n = re.compile(r"(s?(ua)+)?\Z"), len(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = (i, roles[:1] == "s", roles[-1:])
        if i == n and accepts.match(roles):
            return cost, audit, lines
        if (state, audit) in done or len(roles) > 2 * n + 4:
            continue
        done.add((state, audit))
        fits = lambda r: re.match(r"s?(ua)*u?\Z", r)
        for role in ("user", "assistant"):
            if fits(roles + role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", i, roles + role[0], (*lines, f"{role}:")))
        if i < n:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, lines))
            if fault in (0, 3):
                more = fault == 3
                if role[:1] and fits(roles + role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if fits(roles + new[0]):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + new[0], (*lines, f"{new}:{text}")))
    raise AssertionError


def wanted(table):
    """The contract's rows of a table, with every sequence of edits searched."""
    show = lambda x: " " if x is None else str(x)
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        f = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        convs[conv] += [] if f == 0 else [(turn, "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text)] * (2 if f == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        told = {r[0] for r in rows} - {None}
        held = faults_of(rows)
        n = Counter(f for _, _, f in held)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, audit, lines = cheapest(held)
        out[conv] = (max(told) - min(told) + 1 - len(told) if told else 0, n[1], n[2], n[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SHOWN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got_of(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in SHOWN) for r in rows}
    assert len(out) == len(rows)
    return out


def test_repair_against_all_edits(spark, chats):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", "s", "", "User", None]), rng.choice(["", " ", "a.", "b", "c! ", "a.", None, "d\n"])) for c in range(200) for _ in range(rng.randint(1, 6))]
    assert got_of(turns.judged(spark.createDataFrame(rows, ROWS))) == wanted(rows)
    assert got_of(turns.judged(chats)) == wanted([r[:4] for r in chats.collect()])


def test_repair_of_the_table(spark):
    table = spark.read.parquet(f"{DIR}/conversations.parquet")
    got = got_of(queries.op11_turns(spark, DIR))
    want = wanted([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert got == want and any("R" in v[6] for v in got.values()) and any("I" in v[6] for v in got.values())


def test_repair_without_rows(spark, chats):
    assert turns.judged(chats.limit(0)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    row = turns.judged(spark.createDataFrame([(gone, 1, "user", "x.")], ROWS)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repaired_turns_of_a_long_conversation(spark):
    """Batches cut it often, and its edits are those of its rows one by one."""
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), f"t{rng.randint(0, 4000)}{rng.choice(['.', ''])}") for i in range(3000)]
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, "7")
    try:
        edits = turns.repaired(spark.createDataFrame(rows, ROWS).repartition(5))
        out = edits.collect()
        told = turns.report(edits).first()
    finally:
        spark.conf.unset(conf)
    held = faults_of([(t, r, x) for _, t, r, x in rows])
    assert [r.step for r in out] == list(range(len(out))) and "".join(r.edit for r in out) == told.audit
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in out if r.role is not None))
    assert [(r.was, r.fault) for r in out if r.edit != "I"] == [(r, f) for r, _, f in held]
    assert [r.text for r in out if r.edit in "KR"] == [x for r, (_, x, _) in zip((r for r in out if r.edit != "I"), held) if r.edit in "KR"]
    # the cost is the least: a plain table over rows and states
    best = {"": 0}
    step = lambda s: {"": [("u", "u")], "s": [("u", "u")], "u": [("a", "a")], "a": [("u", "u")]}[s]
    def closed(d):
        for _ in range(3):
            for s, c in list(d.items()):
                for _, to in step(s):
                    d[to] = min(d.get(to, 1 << 60), c + 2)
        return d
    for role, _, fault in held:
        new = defaultdict(lambda: 1 << 60)
        for s, c in closed(best).items():
            new[s] = min(new[s], c + 3)
            if fault in (0, 3):
                for _, to in step(s):
                    new[to] = min(new[to], c + (0 if role[0] == to else 2) + (fault == 3))
                if s == "" and role[0] == "s":
                    new["s"] = min(new["s"], c + (fault == 3))
        best = dict(new)
    best = closed(best)
    assert told.cost == min(best[""], best["a"])


# ---- chat formatting

def formatted_of(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        convs[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = {}
    for conv, rows in convs.items():
        said = [(r.decode(), t.decode()) for _, _, r, t in sorted(rows)]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        loss = "".join(t for r, t in said if r == "assistant")
        esc = lambda x, more="": re.sub(r"(\\|###|</turn>" + more + ")", r"\\\1", x)
        whole = "".join("### " + esc(r, "|\n") + ":\n" + esc(t) + "\n</turn>\n" for r, t in said)
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), len(whole))
    return out


CHAT = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def test_formatting_reads_back(spark, chats):
    for df in (chats, spark.read.parquet(f"{DIR}/conversations.parquet")):
        messages = chat.folded(chat.log(chat.numbered(df)).repartition(4, "text"))
        out = chat.rendered(messages)
        assert all(r.formatted == "".join(s.text for s in r.segments) for r in out.collect())
        got = {r.conv_id: tuple(r[c] for c in CHAT) for r in chat.digests(out).collect()}
        assert got == formatted_of([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    got = {r.conv_id: tuple(r[c] for c in CHAT) for r in queries.op12_chat(spark, DIR).collect()}
    assert got[-7] == formatted_of([(-7, 0, "user", chat.SAID), (-7, 1, "assistant", chat.SAID)])[-7]
    assert chat.digests(chat.rendered(chat.folded(chat.log(chat.numbered(chats.limit(0)))))).count() == 0


def test_any_text_reads_back(spark):
    rng = random.Random(2)
    bits = ["\\", "#", "##", "###", "</turn>", "\n", "### user:\n", ":\n", "</tu", "rn>", "x", "\r", "é"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
    rows = [(c, m, text(), text()) for c in range(150) for m in range(3)]
    out = chat.rendered(spark.createDataFrame(rows, "conv_id long, message long, role string, text string"))
    for r in out.select("conv_id", chat.read(F.col("formatted")).alias("t")).collect():
        assert [tuple(x) for x in r.t] == [(role, x) for _, _, role, x in rows[3 * r.conv_id : 3 * r.conv_id + 3]]


def test_folding_is_replay(spark):
    """Random logs against a plain replay of their events."""
    rng = random.Random(6)
    events, want = [], {}
    for c in (1, 2, None):
        for m in range(40):
            role, text = "", ""
            for s in range(rng.randint(1, 12)):
                kind = rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate"]) if s else "open"
                r = rng.choice(["user", "assistant"]) if kind == "open" else None
                x = rng.choice([None, "", f"<{s}>"])
                events.append((c, m, 5 * s, kind, r, x))
                role = r or role
                text = (x or "") if kind in chat.RESETS else text + (x or "")
            want[c, m] = (role, text)
    rng.shuffle(events)
    df = spark.createDataFrame(events, "conv_id long, message long, seq long, kind string, role string, text string").withColumn("held", F.lit(1))
    assert {(r.conv_id, r.message): (r.role, r.text) for r in chat.folded(df).collect()} == want


# ---- vector codes

def codes_of(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error and label_error by plain loops over whole numbers, and the codebooks."""
    import math

    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in rows) // parts) * parts
    rows = [(i, v + [0] * (width - len(v)), label) for i, v, label in rows]
    size = width // parts
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        members = [[[] for _ in first] for _ in range(parts)]
        for _, v, _ in rows:
            for p in range(parts):
                members[p][near(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(m) for c in zip(*m)] if m else books[p][e] for e, m in enumerate(members[p])] for p in range(parts)]
    out, of_label = [], Counter()
    for i, v, label in rows:
        found = [near(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        of_label[label] += out[-1][2]
    return sorted(((i, c, e, of_label[label]) for i, c, e, label in out), key=repr), books


def told_of(df):
    coded, books = codes.compressed(df)
    out = codes.with_label_error(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error")
    return sorted((tuple(r) for r in out.collect()), key=repr), books.tolist()


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_against_plain_loops(spark):
    rng = np.random.default_rng(1)
    nan, inf = float("nan"), float("inf")
    rows = [(int(i), rng.normal(0, 0.2, 32).round(2).tolist(), int(i) % 3 if i % 7 else None) for i in rng.permutation(300)]
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (None, rows[1][1], 2), (None, None, None), (900, None, 1), (901, [0.5, None] * 16, 1), (902, [nan] * 32, 1), (903, [-inf] + [0.0] * 31, 1), (904, [], 1), (905, [-0.25] * 20, 0), (7, rows[3][1], 99)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("code", "error", "label_error", "n", "block", "of_label")}).repartition(5)
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert told_of(df) == codes_of(rows)
    few = [r for r in rows if r[1] is not None and len(r[1]) == 32][:3]
    assert told_of(spark.createDataFrame(few, VECTORS)) == codes_of(few)
    assert codes.with_label_error(codes.compressed(df.limit(0))[0]).count() == 0
    assert codes.with_label_error(codes.compressed(df.where("vec_id = 900"))[0]).count() == 0


def test_seldom_and_hot_labels(spark):
    coded = spark.range(5000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 2000, None).otherwise((F.col("id") / 2).cast("int")).alias("label"), F.lit(b"x").alias("code"), F.col("id").alias("error"))
    got = {r.vec_id: r.label_error for r in codes.with_label_error(coded).collect()}
    assert got == {i: sum(range(2000)) if i < 2000 else 2 * (i // 2 * 2) + 1 for i in range(5000)}


def test_codes_stand_for_vectors(spark):
    """Training lowers the error, and decoding gives vectors at the distance that is told."""
    df = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = codes.kept(df)
    told = codes.blocks(rows)
    start = codes.first_books(rows, told.width, told.parts, 64)
    coded, books = codes.compressed(df)
    total = lambda b: codes.encode(told, b).agg(F.sum("error")).first()[0]
    assert total(books) < total(start)
    vectors = {r.vec_id: np.floor(256 * np.array(r.embedding, np.float64)) for r in df.collect()}
    back = {r.vec_id: np.array(r.embedding) * 256 for r in codes.decoded(coded, books).collect()}
    assert all(round(((vectors[r.vec_id] - back[r.vec_id]) ** 2).sum()) == r.error for r in coded.collect())


def test_new_queries_are_registered():
    assert {"op11_turns", "op12_chat", "op13_codes"} <= set(queries.queries())
