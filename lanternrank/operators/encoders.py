"""What a model must offer, and deterministic stand-ins.

A sparse encoder maps (item, text) rows to postings, a dense encoder adds an
array column, a pair scorer maps two text columns to a score column.  Real
models run in iterator pandas functions that load them once a worker;
`encode_batches` gives such a loop its fallbacks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternrank.functions.text import chunks, tokens
from lanternrank.functions.vectors import FLOOR


class SparseEncoder(Protocol):
    def __call__(self, rows: DataFrame, item: str) -> DataFrame: ...


class DenseEncoder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class PairScorer(Protocol):
    def __call__(self, query: Column, text: Column) -> Column: ...


def term_weights(rows: DataFrame, item: str = "docid") -> DataFrame:
    """Stand-in sparse encoder: item, term, ln(1 + count)."""
    return rows.select(item, F.explode(tokens(F.col("text"))).alias("term")).groupBy(item, "term").agg(F.log1p(F.count("*")).alias("weight"))


def _whole(batches, key: str):
    """(rows, where each key starts) of batches in which the rows of a key stand together: what is left of a key goes before the next."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([rest, b] if rest is not None else [b]).combine_chunks().to_batches()[0]
        codes = t.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
        start = np.flatnonzero(np.concatenate(([True], np.diff(codes) != 0)))
        rest = t.slice(start[-1])
        if len(start) > 1:
            yield t.slice(0, start[-1]), start[:-1]
    if rest is not None:
        yield rest, np.array([0])


def gathered(rows: DataFrame, key: str, by: str | None = None, counted: bool = False) -> DataFrame:
    """key, norm, terms and weights: each term of a key once, in order, with its largest weight (counted: ln(1 + occurrences)).

    rows: key and a text (counted), or key, terms and weights; by: a column that
    the key decides, whose rows stay together.  Rows move as they are, once, and
    are gathered in whole batches; what is left of a key goes before the next.
    Keys without terms are left out.
    """
    by = by or key
    held = rows.select(*dict.fromkeys([by, key]), *(["text"] if counted else ["terms", "weights"])).repartition(by).sortWithinPartitions(key)
    none = F.array().cast("array<string>")
    held = held.select(key, F.coalesce(tokens(F.col("text")), none).alias("terms")) if counted else held.select(key, "terms", "weights")
    kind = held.schema[key].dataType

    def gather(t: pa.RecordBatch, start: np.ndarray) -> pa.RecordBatch:
        column, codes = t.column("terms"), t.column("terms").flatten().dictionary_encode()
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        rank = np.empty(len(codes.dictionary), np.int64)
        order = pa.compute.sort_indices(codes.dictionary)
        rank[order.to_numpy()] = np.arange(len(order))
        width = max(len(rank), 1)
        row = np.repeat(np.repeat(np.arange(len(start)), np.diff(np.append(start, t.num_rows))), lengths)
        places = row * width + rank[codes.indices.to_numpy(zero_copy_only=False)]
        if counted:
            places, n = np.unique(places, return_counts=True)
            weights = np.log1p(n)
        else:
            sorting = np.argsort(places, kind="stable")
            every = t.column("weights").flatten().to_numpy(zero_copy_only=False)[sorting]
            places, first = np.unique(places[sorting], return_index=True)
            weights = np.maximum.reduceat(every, first) if len(first) else every
        ends = np.searchsorted(places // width, np.arange(len(start) + 1))
        squares = np.concatenate(([0.0], weights * weights))
        norms = np.sqrt([squares[a + 1 : b + 1].sum() for a, b in zip(ends[:-1], ends[1:])])
        names, offsets = codes.dictionary.take(order).take(pa.array(places % width)), pa.array(ends, pa.int32())
        columns = [t.column(key).take(pa.array(start)), pa.array(norms, pa.float64()), pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(weights, pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=[key, "norm", "terms", "weights"]).filter(pa.array(np.diff(ends) > 0))

    def run(batches):
        for t, start in _whole(batches, key):
            yield gather(t, start)

    return held.mapInArrow(run, T.StructType([T.StructField(key, kind), *T._parse_datatype_string("norm double, terms array<string>, weights array<double>").fields]))


def term_vectors(rows: DataFrame, item: str = "docid", by: str | None = None) -> DataFrame:
    """`term_weights` as a row an item, with the norm: item, norm, terms, weights; texts meet one exchange and no row a term is made."""
    return gathered(rows, item, by, counted=True)


#: Encoders that have `vectors` (rows, item, by) give an item's postings in one row.
term_weights.vectors = term_vectors


def hashed(rows: DataFrame, dims: int = 64, item: str = "docid") -> DataFrame:
    """Stand-in dense encoder: item and the unit vector of its term weights, summed by a hash of the term; items without terms are left out."""
    held = term_vectors(rows, item)

    def run(batches):
        for b in batches:
            codes = b.column("terms").flatten().dictionary_encode()
            place = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dims for t in codes.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(b.num_rows), b.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            at = row * dims + (place[codes.indices.to_numpy(zero_copy_only=False)] if len(place) else 0)
            sums = np.bincount(at, b.column("weights").flatten().to_numpy(zero_copy_only=False), b.num_rows * dims).reshape(b.num_rows, dims)
            sums /= np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), FLOOR)
            ends = pa.array(np.arange(b.num_rows + 1) * dims, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(item), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], names=[item, "vector"])

    return held.mapInArrow(run, T.StructType([held.schema[item], T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def chunk_weights(rows: DataFrame, budget: int, item: str = "docid") -> DataFrame:
    """The stand-in on chunks: item, chunk, n_tokens, term, weight."""
    parts = rows.select(item, F.posexplode(chunks(tokens(F.col("text")), budget)).alias("chunk", "toks"))
    terms = parts.select(item, "chunk", F.size("toks").alias("n_tokens"), F.explode("toks").alias("term"))
    return terms.groupBy(item, "chunk", "n_tokens", "term").agg(F.log1p(F.count("*")).alias("weight"))


def max_pool(weights: DataFrame, item: str = "docid") -> DataFrame:
    return weights.groupBy(item, "term").agg(F.max("weight").alias("weight"))


def mean_pool(weights: DataFrame, item: str = "docid") -> DataFrame:
    """Token-weighted mean over an item's chunks; a chunk without the term counts as zero."""
    size = weights.select(item, "chunk", "n_tokens").distinct().groupBy(item).agg(F.sum("n_tokens").alias("total"))
    sums = weights.groupBy(item, "term").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("s"))
    return sums.join(size, item).select(item, "term", (F.col("s") / F.col("total")).alias("weight"))


def chunk_means(rows: DataFrame, budget: int, item: str = "docid") -> DataFrame:
    """`mean_pool` of `chunk_weights`: item, term, weight.  Texts move once, as they are; an item's chunks are counted and pooled in one batch, so no row a term moves."""
    if budget < 1:
        raise ValueError("a chunk needs a token at least")
    none = F.array().cast("array<string>")
    held = rows.select(item, "text").repartition(item).sortWithinPartitions(item).select(item, F.coalesce(tokens(F.col("text")), none).alias("terms"))

    def run(batches):
        for t, start in _whole(batches, item):
            codes = t.column("terms").flatten().dictionary_encode()
            lengths = t.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.repeat(np.arange(len(start)), np.diff(np.append(start, t.num_rows))), lengths)
            first = np.repeat(np.cumsum(lengths) - lengths, lengths)
            chunk = (np.arange(len(owner)) - first) // budget
            size = np.minimum(budget, np.repeat(lengths, lengths) - chunk * budget)
            # a chunk is known by its item, number and size, as in chunk_weights
            most = chunk.max(initial=0) + 1
            every, part = np.unique((owner * most + chunk) * (budget + 1) + size, return_inverse=True)
            of, tokens_of = every // (budget + 1) // most, every % (budget + 1)
            total = np.bincount(of, tokens_of, len(start))
            width = max(len(codes.dictionary), 1)
            places, n = np.unique(part * width + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
            part, term = places // width, places % width
            found, place = np.unique(of[part] * width + term, return_inverse=True)
            weights = np.bincount(place, np.log1p(n) * tokens_of[part], len(found)) / total[found // width]
            yield pa.RecordBatch.from_arrays([t.column(item).take(pa.array(start[found // width])), codes.dictionary.take(pa.array(found % width)), pa.array(weights, pa.float64())], names=[item, "term", "weight"])

    return held.mapInArrow(run, T.StructType([held.schema[item], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))


def parts_of(text: str, n: int) -> list[str]:
    """The text's words in n runs of nearly equal length; a text of fewer words is cut by characters."""
    words = text.split()
    units, glue = (words, " ") if len(words) >= n else (list(text), "")
    step = max(1, -(-len(units) // n))
    return [glue.join(units[i : i + step]) for i in range(0, len(units), step)]


def attempts(batches: Iterator[pd.Series], encode: Callable[[list[str]], list], most_parts: int = 11) -> Iterator[list[tuple]]:
    """(vector, error) of each text of each batch; a failing batch is tried text by text, a failing text in 2 to `most_parts` parts whose mean is normalised.  What still fails has no vector, but the first error."""
    import numpy as np

    def in_parts(text: str, error: str):
        for n in range(2, most_parts + 1):
            try:
                got = encode(parts_of(text, n))
            except Exception:  # noqa: BLE001  whatever a model raises
                continue
            mean = np.mean(np.asarray(got, float), axis=0)
            length = float(np.linalg.norm(mean))
            return ((mean / length).tolist(), None) if length > 0 else (None, "the mean of its parts is zero")
        return None, error

    def alone(text: str):
        try:
            return encode([text])[0], None
        except Exception as e:  # noqa: BLE001
            return in_parts(text, f"{type(e).__name__}: {e}")

    for b in batches:
        try:
            yield [(v, None) for v in encode(b.tolist())]
        except Exception:  # noqa: BLE001
            yield [alone(t) for t in b]


def encode_batches(batches: Iterator[pd.Series], encode: Callable[[list[str]], list], most_parts: int = 11) -> Iterator[pd.Series]:
    """The vectors of `attempts`."""
    def index(held):
        for b in batches:
            held.append(b.index)
            yield b

    held: list = []
    for found in attempts(index(held), encode, most_parts):
        yield pd.Series([v for v, _ in found], index=held.pop(), dtype=object)


def hashed_loader(dims: int = 64) -> Callable[[], Callable[[list[str]], list]]:
    """`hashed` as a model that is loaded once a task; a text without terms has a zero vector."""

    def load():
        import math

        @lru_cache(1 << 16)
        def place(term):
            return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dims

        def encode(texts):
            out = []
            for t in texts:
                v, counts = [0.0] * dims, {}
                for term in t.lower().split():
                    counts[term] = counts.get(term, 0) + 1
                for term, n in counts.items():
                    v[place(term)] += math.log1p(n)
                length = math.sqrt(sum(x * x for x in v)) or 1.0
                out.append([x / length for x in v])
            return out

        return encode

    return load


def encoded(rows: DataFrame, load: Callable[[], Callable[[list[str]], list]], text: str = "text", vector: str = "vector", batch: int = 16, error: str | None = None) -> DataFrame:
    """rows with a column of vectors, and one of errors if `error` names it; `load` is called once a task and gives the encoder, null texts read as empty."""
    names = [vector, *([error] if error else [])]
    kept = rows.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(vector, T.ArrayType(T.DoubleType())), *([T.StructField(error, T.StringType())] if error else [])])

    def run(frames):
        encode = load()
        for f in frames:
            pieces = (f[text].fillna("")[i : i + batch] for i in range(0, len(f), batch))
            found = [x for part in attempts(pieces, encode) for x in part]
            vectors = [None if v is None else [float(x) for x in v] for v, _ in found]
            columns = dict(zip(names, (vectors, [e for _, e in found])))
            yield f.assign(**{n: pd.Series(c, index=f.index, dtype=object) for n, c in columns.items()})

    return kept.mapInPandas(run, schema)
