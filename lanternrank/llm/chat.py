"""Chat formatting from an event log: DataFrame functions only.

A log has events of messages in any order: `open` names the role, `delta` adds a
streamed piece, `edit` puts a whole text in place of what there is, and
`regenerate` drops what was streamed so far.  Logs are partitioned by
conversation and ordered by sequence; the last event that resets a message is
found first, what it made void goes before anything is gathered, and the rest is
joined to the final text.  All steps need a conversation's rows together, so
they share one exchange; texts are gathered a message at a time, and formatted
ones a conversation, which is what is returned.

Template: ``### role:``, a line feed, the text, a line feed, ``</turn>`` and a line
feed.  In roles and texts a backslash stands before each backslash, ``###`` and
``</turn>`` (in roles before line feeds too), so a line that begins with ``</turn>``
ends a turn and the first ``:`` before a line feed ends its role, whatever the
texts hold, and taking the backslashes away gives them back.  The loss mask is a
flag on each segment: assistant texts have it.

Defined cases: null roles and texts are empty; a null conv_id is a conversation
of its own; equal rows are a turn each; rows of equal turn go by role and text;
a message without a text is an empty turn; an empty log gives no rows.  Columns
that the functions don't name are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, END, MARK = "### ", "\n</turn>\n", ":\n"
CONTROL = r"(\\|###|</turn>)"
CONTROL_ROLE = r"(\\|###|</turn>|\n)"
ESCAPED = r"\\(\\|###|</turn>|\n)"
RESETS = ("open", "edit", "regenerate")
SAID = "\\### Assistant: </turn> ok"
PIECES = 8


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# ---- the log of a table of conversations

def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, message (from 1, by turn), role and text; null turns first, then by role and text."""
    rows = rows.select("conv_id", "turn", _empty("role").alias("role"), _empty("text").alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", F.row_number().over(w).cast("long").alias("message"), "role", "text")


def log(messages: DataFrame) -> DataFrame:
    """Events (conv_id, message, seq, kind, role, text) that end in the given messages.

    By the message's number and length, a text is streamed at once, streamed
    anew after a draft was dropped, put in place of a draft, or drafted, edited
    and streamed anew.
    """
    role, none, text = F.col("role"), F.lit(None).cast("string"), F.col("text")
    size = F.greatest(F.ceil(F.length("text") / PIECES), F.lit(1)).cast("int")
    event = lambda kind, r, t: F.struct(F.lit(kind).alias("kind"), r.alias("role"), t.alias("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: event("delta", none, F.substring(text, i * size + 1, size)))
    opened, again, edit = F.array(event("open", role, none)), F.array(event("regenerate", none, none)), F.array(event("edit", none, text))
    draft = F.array(event("delta", none, F.concat(F.lit("draft: "), F.left("text", F.lit(16)))), event("delta", none, F.lit(END)))
    way = (F.col("message") + F.length("text")) % 4
    events = F.when(way == 0, F.concat(opened, pieces)).when(way == 1, F.concat(opened, draft, again, pieces)).when(way == 2, F.concat(opened, draft, edit)).otherwise(F.concat(opened, draft, edit, draft, again, pieces))
    return messages.select("conv_id", "message", F.posexplode(events).alias("seq", "e")).select("conv_id", "message", F.col("seq").cast("long"), "e.kind", "e.role", "e.text")


# ---- from events to messages

def folded(events: DataFrame) -> DataFrame:
    """conv_id, message, role and text of every message of a log (conv_id, message, seq, kind, role, text); events of one seq go by kind and text."""
    reset = F.max(F.when(F.col("kind").isin(*RESETS), F.col("seq"))).over(Window.partitionBy("conv_id", "message"))
    named = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).over(Window.partitionBy("conv_id", "message"))
    spaced = events.select("conv_id", "message", "seq", "kind", "text", named.alias("role"), reset.alias("reset"))
    alive = spaced.where(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
    held = F.array_sort(F.collect_list(F.struct("seq", "kind", _empty("text").alias("text"))))
    whole = alive.groupBy("conv_id", "message").agg(F.first("role").alias("role"), held.alias("held"))
    return whole.select("conv_id", "message", _empty("role").alias("role"), F.array_join(F.transform("held", lambda e: e["text"]), "").alias("text"))


# ---- template

def escaped(c: Column, pattern: str = CONTROL) -> Column:
    return F.regexp_replace(c, pattern, r"\\$1")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1")


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and segments (text and whether it counts for the loss) of each conversation; segments joined are the formatted text."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), CONTROL_ROLE), F.lit(MARK))
    turn = F.struct("message", head.alias("head"), escaped(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss"))
    held = messages.withColumns({"role": _empty("role"), "text": _empty("text")}).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(part(t["head"], F.lit(False)), part(t["text"], t["loss"]), part(F.lit(END), F.lit(False)))))
    return held.select("conv_id", segments.alias("segments")).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.split(formatted, END)

    def turn(t):
        at = F.instr(t, MARK)
        return F.struct(unescaped(F.substr(t, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescaped(F.substr(t, at + len(MARK))).alias("text"))

    return F.transform(F.slice(turns, 1, F.size(turns) - 1), turn)


def masked(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digests(out: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of `rendered`, all read back from it."""
    back = out.select("conv_id", read(F.col("formatted")).alias("turns"), masked(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def tried(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation table and conversation -7, whose two texts hold the template's own marks."""
    said = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(said)


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(regexp_replace(role, '(\\|###|</turn>|\n)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 15 AS n FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
