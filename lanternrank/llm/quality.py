"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, four to a block; filters look at two neighbouring blocks
(eight bytes, a step of four), and each is max-pooled over chunks of 256 bytes
that overlap by half and cover the whole document.  Mean and maximum of the
chunks' responses give one probability.  The network is fitted on a bounded
sample of labelled rows (`sample_per_class`), chosen by hash; long ones teach
by a passage.

Defined cases: null text reads as empty and an empty text is one chunk of
padding, so it gets a score too; null or repeated ids score like any row;
without labels of both classes every score is 0.5; extra columns pass through
`classify` unless they are named like its results, which replace them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK, SUB = 4, 32  # bytes a block; blocks a half chunk
DIM, FILTERS = 8, 16


@dataclass
class Net:
    emb: np.ndarray  # 256 x DIM
    conv: np.ndarray  # 2 * BLOCK * DIM x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    out_bias: float

    @staticmethod
    def fresh(seed: int) -> "Net":
        r = np.random.default_rng(seed)
        return Net(r.normal(0, 0.5, (256, DIM)).astype("f4"), r.normal(0, 0.15, (2 * BLOCK * DIM, FILTERS)).astype("f4"), np.zeros(FILTERS, "f4"), r.normal(0, 0.1, 2 * FILTERS).astype("f4"), 0.0)


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros to whole half chunks and one empty block at least; first half chunk of each."""
    width = BLOCK * SUB
    room = [(len(t) + BLOCK + width - 1) // width * width for t in texts]
    data = b"".join(t.ljust(n, b"\0") for t, n in zip(texts, room))
    return np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(room))) // width


def _forward(net: Net, texts: list[bytes]):
    data, first = _layout(texts)
    blocks = net.emb[data].reshape(-1, BLOCK * DIM)
    half = BLOCK * DIM
    conv = blocks @ net.conv[:half]
    conv[:-1] += blocks[1:] @ net.conv[half:]
    ends = first[1:] * SUB - 1  # a text's last block is followed by padding, not by the next text
    pad = np.tile(net.emb[0], BLOCK)
    conv[ends] = pad @ net.conv[:half] + pad @ net.conv[half:]
    sub = conv.reshape(-1, SUB, FILTERS)
    top = sub.max(axis=1)
    after = np.vstack((top[1:], top[-1:]))
    after[first[1:] - 1] = top[first[1:] - 1]
    chunk = np.tanh(np.maximum(top, after) + net.bias)
    n = np.diff(first)[:, None]
    mean = np.add.reduceat(chunk, first[:-1], axis=0) / n
    most = np.maximum.reduceat(chunk, first[:-1], axis=0)
    logit = np.hstack((mean, most)) @ net.out + net.out_bias
    return logit, (data, first, blocks, sub, top, after, chunk, n, mean, most, ends)


def _tops(net: Net, data: np.ndarray, first: np.ndarray, step: int = 512) -> np.ndarray:
    """Each half chunk's largest response of each filter, worked out `step` half chunks at a time: embeddings of no more than that are held."""
    half, width = BLOCK * DIM, BLOCK * SUB
    top, ends = np.empty((len(data) // width, FILTERS), "f4"), first[1:] * SUB - 1
    zero = np.tile(net.emb[0], BLOCK)
    padded = zero @ net.conv[:half] + zero @ net.conv[half:]
    for at in range(0, len(top), step):
        n = min(step, len(top) - at)
        part = data[at * width : (at + n) * width + BLOCK]
        blocks = net.emb[part].reshape(-1, half)
        conv = blocks[: n * SUB] @ net.conv[:half]
        conv[: len(blocks) - 1] += blocks[1:] @ net.conv[half:]
        inside = ends[np.searchsorted(ends, at * SUB) : np.searchsorted(ends, (at + n) * SUB)]
        conv[inside - at * SUB] = padded
        top[at : at + n] = conv.reshape(-1, SUB, FILTERS).max(axis=1)
    return top


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    """Of label 1 for each text; memory beyond the texts is less than twice their bytes."""
    data, first = _layout(texts)
    top = _tops(net, data, first)
    after = np.vstack((top[1:], top[-1:]))
    after[first[1:] - 1] = top[first[1:] - 1]
    chunk = np.maximum(top, after, out=after)
    chunk += net.bias
    np.tanh(chunk, out=chunk)
    mean = np.add.reduceat(chunk, first[:-1], axis=0) / np.diff(first)[:, None]
    most = np.maximum.reduceat(chunk, first[:-1], axis=0)
    logit = np.hstack((mean, most)) @ net.out + net.out_bias
    return 1 / (1 + np.exp(-np.clip(logit.astype("f8"), -30, 30)))


def _gradients(net: Net, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    logit, (data, first, blocks, sub, top, after, chunk, n, mean, most, ends) = _forward(net, texts)
    g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype("f4")
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    g_out = np.hstack((mean, most)).T @ g
    hit = (chunk == most[doc]).astype("f4")  # chunks of equal response share the maximum's gradient
    hit /= np.add.reduceat(hit, first[:-1], axis=0)[doc]
    g_chunk = (g[:, None] * net.out[:FILTERS] / n)[doc] + (g[:, None] * net.out[FILTERS:])[doc] * hit
    g_chunk = g_chunk * (1 - chunk**2)
    own = top >= after
    g_top = g_chunk * own
    moved = (g_chunk * ~own)[:-1]
    g_top[1:] += moved
    where = sub.argmax(axis=1)
    rows = np.arange(len(top))[:, None] * SUB + where
    g_conv = np.zeros((len(blocks), FILTERS), "f4")
    np.add.at(g_conv, (rows, np.arange(FILTERS)[None, :]), g_top)
    g_conv[ends] = 0
    half = BLOCK * DIM
    g_w = np.vstack((blocks.T @ g_conv, blocks[1:].T @ g_conv[:-1]))
    g_blocks = g_conv @ net.conv[:half].T
    g_blocks[1:] += g_conv[:-1] @ net.conv[half:].T
    flat = g_blocks.reshape(-1, DIM)
    g_emb = np.stack([np.bincount(data, flat[:, k], 256) for k in range(DIM)], axis=1)
    return [g_emb, g_w, g_chunk.sum(0), g_out, np.array(g.sum())]


def _cut(text: bytes, r: np.random.Generator) -> bytes:
    """A random passage of a training text: short documents are rare in a sample."""
    n = int(np.exp(r.uniform(np.log(6), np.log(300))))
    at = int(r.integers(0, max(1, len(text) - n)))
    return text[at : at + n]


def fit(texts: list[bytes], y: np.ndarray, seed: int = 7, epochs: int = 8, batch: int = 32, rate: float = 0.01) -> Net | None:
    """Adam on the cross entropy; both classes weigh the same.  None where a class is missing."""
    y = np.asarray(y, "f4")
    if len(set(y.tolist())) < 2:
        return None
    net, r = Net.fresh(seed), np.random.default_rng(seed)
    low, high = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    each = max(len(low), len(high))
    state = [(0.0, 0.0)] * 5
    step = 0
    for _ in range(epochs):
        order = np.stack([r.permutation(np.resize(r.permutation(k), each)) for k in (low, high)], axis=1).ravel()
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            step += 1
            grads = _gradients(net, [_cut(texts[i], r) if k % 3 == 0 else texts[i] for k, i in enumerate(pick)], y[pick])
            values = [net.emb, net.conv, net.bias, net.out, np.array(net.out_bias)]
            new = []
            for k, (v, g) in enumerate(zip(values, grads)):
                m, s = state[k]
                m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
                state[k] = (m, s)
                new.append((v - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype("f4"))
            net = Net(*new[:4], float(new[4]))
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_per_class: int = 2000, fold: int = 3, held: int = 1, seed: int = 7, most_bytes: int = 1 << 16) -> Net | None:
    """Fit on at most `sample_per_class` labelled rows of each class, none of them held out.

    The rows are the lowest by a hash of their id; of repeated ids, the smallest
    text.  Only that sample reaches the driver, at most 2 * sample_per_class *
    most_bytes bytes: a text of more than most_bytes bytes teaches by a passage
    of most_bytes // 4 code points, at a place drawn by the hash of its id.  An
    id with several labels counts under each, if it is drawn.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & (common.doc_hash_mod("doc_id", fold) != held)).distinct()
    chosen = None
    for k in (0, 1):
        part = usable.where(F.col("y") == k).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    whole, take = F.coalesce("text", F.lit("")), most_bytes // 4  # a code point has four bytes at most
    start = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.greatest(F.length(whole) - take + 1, F.lit(1))).cast("int") + 1
    texts = docs.select("doc_id", F.when(F.octet_length(whole) <= most_bytes, whole).otherwise(F.substring(whole, start, F.lit(take))).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text, r.y))
    return fit([r.text.encode() for r in rows], np.array([r.y for r in rows]), seed)


def classify(docs: DataFrame, net: Net | None, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a column `score`, the probability of label 1 for the whole text."""
    kept = docs.drop(score)
    schema = T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType(), False)])

    def run(batches):
        for b in common.pieces(batches, 1 << 20, text):
            p = np.full(b.num_rows, 0.5) if net is None else probabilities(net, common.utf8(b.column(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, score])

    return kept.mapInArrow(run, schema)
