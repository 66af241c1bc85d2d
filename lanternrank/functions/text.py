"""Text expressions: ids, prefixes, tokens and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the instruction that the query embeddings were made with.
INSTRUCTION = "Given a scientific research question, retrieve paragraphs from scientific papers that are relevant to answering the question."


def strip(c: Column) -> Column:
    """Without white space at both ends (Spark's trim removes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def paper_id_last(docid: Column) -> Column:
    """Everything before the last underscore; the whole id if it has none."""
    return F.regexp_replace(docid, "_[^_]*$", "")


def paper_id_first(docid: Column) -> Column:
    """Everything before the first underscore."""
    return F.split_part(docid, F.lit("_"), F.lit(1))


def is_front(docid: Column) -> Column:
    return docid.rlike("_0$")


def front_text(title: Column, abstract: Column) -> Column:
    """The pseudo-passage of a paper's head; missing fields are empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))


def instruct(query: Column, instruction: str = INSTRUCTION) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), query)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def chunks(toks: Column, budget: int) -> Column:
    """Consecutive slices of at most `budget` tokens; none for no tokens."""
    if budget < 1:
        raise ValueError("a chunk needs a token at least")
    starts = F.sequence(F.lit(1), F.size(toks), F.lit(budget))
    return F.when(F.size(toks) > 0, F.transform(starts, lambda i: F.slice(toks, i, F.lit(budget)))).otherwise(F.slice(F.array(toks), 1, 0))


def sig3(p: Column) -> Column:
    """Three significant digits; zero stays zero."""
    scale = F.pow(F.lit(10.0), 2 - F.floor(F.log10(F.abs(p))))
    return F.when(p == 0, F.lit(0.0)).otherwise(F.round(p * scale) / scale)
