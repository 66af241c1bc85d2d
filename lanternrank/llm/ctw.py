"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions.  A decision's node (the bits before it in
its byte) has a context tree whose edges are the bytes before, youngest first.
Every context holds a Krichevsky-Trofimov estimate, and the weighted
probability of a context is half its own estimate plus half the product over
its extensions; predictions so mix the estimates of all depths from 0 to
`DEPTH` by their posterior weights.  Scores are log10 probabilities of the
lower-cased text and one end symbol, the byte 255, which no UTF-8 text holds.

The tree grows with the corpus: every context of up to two bytes and every
longer one seen `least` times in training is a node of its own (what the other
extensions of a node hold is pooled in one more child, so no count is lost),
and no task holds all of it:

1. Each task cuts its texts into chunks and tells the distinct windows (five
   bytes and the next) of each, with their training counts, by the two
   youngest bytes of their context.
2. Windows are exchanged by that pair of bytes, so a task has a whole subtree:
   it counts, weighs it from the leaves up, and writes it.  Of corpora beyond
   `salt_bytes` each pair's chunks are dealt to several tasks, which merge their
   windows first, so that only distinct ones meet in the subtree's task.
3. The two upper levels, of at most 257 contexts, are put together on the
   driver from the subtrees' sums.
4. Each subtree prices its windows, and the prices go back to the chunks.
5. Texts are cut into the same chunks again, and their windows' prices added.

So what is exchanged is distinct windows of chunks, not positions, and nothing
but the two upper levels is broadcast.  A task's memory follows the windows of
one pair of bytes, or of one chunk.

The base score adds log10((c + 1) / (N + V + 1)) over words and one end token.
Words with at least a `frequent`-th part of all tokens, at most that many, are
broadcast; all other words join the vocabulary by shuffle.

Defined cases: null text reads as empty and has only its end; null ids count as
the empty text when the fold is chosen; repeated rows are scored one by one;
texts of any length are cut within; no training rows give uniform bytes and a
base of zero; empty tables give empty results; extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

DEPTH, LEAST, FREQUENT, CHUNK = 5, 64, 1 << 17, 4 << 20
END = b"\xff"
SYM = np.arange(256)


# ---- windows of chunks

@dataclass
class Segment:
    row: int  # number of the text in its task
    data: bytes  # DEPTH bytes of context, then the segment's own
    last: bool


def segments(texts: Iterable[bytes], most: int = CHUNK) -> Iterator[list[Segment]]:
    """Chunks of `most` positions (bytes and ends) of the lower-cased texts in their order; long texts are cut anywhere."""
    chunk, room = [], most
    for row, text in enumerate(texts):
        data, n, at = END * DEPTH + text.lower() + END, len(text) + 1, 0
        while at < n:
            take = min(room, n - at)
            chunk.append(Segment(row, data[at : at + take + DEPTH], at + take == n))
            at, room = at + take, room - take
            if not room:
                yield chunk
                chunk, room = [], most
    if chunk:
        yield chunk


def windows(chunk: list[Segment]) -> tuple[np.ndarray, np.ndarray]:
    """The window of each position, its context's youngest byte first and its own byte last, and where each segment's begin."""
    size = np.fromiter((len(s.data) for s in chunk), np.int64, len(chunk))
    data = np.frombuffer(b"".join(s.data for s in chunk), np.uint8)
    key = data[DEPTH:].astype(np.int64)
    for k in range(1, DEPTH + 1):
        part = data[DEPTH - k : len(data) - k].astype(np.int64)
        part <<= 8 * (DEPTH + 1 - k)
        key |= part
    own = np.ones(len(key), bool)  # without the windows that start in one segment and end in the next
    ends = np.cumsum(size)[:-1]
    for k in range(DEPTH):
        own[ends - DEPTH + k] = False
    return key[own], np.concatenate(([0], np.cumsum(size - DEPTH)[:-1]))


def ranks(keys: np.ndarray) -> np.ndarray:
    """Each key's place among the distinct ones in order.

    Keys are packed with their positions where the bytes that occur leave room for it, for numbers sort much faster than places do.
    """
    n, pairs = len(keys), np.zeros(1 << 16, bool)
    for k in (0, 16, 32):
        pairs[(keys >> k) & 0xFFFF] = True
    pairs = pairs.reshape(256, 256)
    own = pairs.any(axis=0) | pairs.any(axis=1)
    width, free = max(1, (int(own.sum()) - 1).bit_length()), max(1, (n - 1).bit_length())
    if width * (DEPTH + 1) + free > 64:
        order = np.argsort(keys)
        keys = keys[order]
    else:
        small = np.where(own, np.cumsum(own) - 1, 0).astype(np.uint64)
        small = (small[:, None] << np.uint64(width) | small).ravel()
        packed = small[keys >> 32]
        for k in (16, 0):
            packed <<= np.uint64(2 * width)
            packed |= small[(keys >> k) & 0xFFFF]
        packed <<= np.uint64(free)
        packed |= np.arange(n, dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << free) - 1)).astype(np.int64)
        packed >>= np.uint64(free)
        keys = packed
    new = np.ones(n, np.int32)
    new[0] = 0
    new[1:] = keys[1:] != keys[:-1]
    out = np.empty(n, np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def _planes(a: np.ndarray) -> bytes:
    """Numbers with their bytes side by side by significance: the high ones, mostly alike, then take little room in files."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _numbers(data: bytes, kind) -> np.ndarray:
    """What `_planes` took."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of data between cuts (numbers of elements) as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def told(chunk: list[Segment], held: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's distinct windows in order, and how often each stands in rows that aren't held out."""
    keys, first = windows(chunk)
    keys <<= 1
    keys |= np.repeat(np.array([held[s.row] for s in chunk], np.uint8), np.diff(np.append(first, len(keys))))
    keys.sort()
    out = (keys & 1).astype(np.uint8)
    keys >>= 1
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[start], (np.diff(np.append(start, len(keys))) - np.add.reduceat(out, start, dtype=np.int64)).astype(np.uint32)


def priced_sums(chunk: list[Segment], price: np.ndarray) -> np.ndarray:
    """Each segment's sum of the prices of its windows; price: of the chunk's distinct windows in order."""
    keys, first = windows(chunk)
    place = ranks(keys)
    del keys
    if len(price) != place.max() + 1:
        raise ValueError("a second reading of the documents gave other rows")
    each = price[place]
    return np.add.reduceat(each, first, dtype=np.float64)


TOLD = "pair int, part int, chunk int, low binary, n binary"


def _tell(chunk_bytes: int):
    """An Arrow map from texts to the windows of their chunks: those of one pair of youngest bytes a row, four bytes each."""

    def run(batches):
        held: list[bool] = []

        def texts():
            for b in common.pieces(batches):
                held.extend(b.column("held_out").to_pylist())
                yield from common.utf8(b.column("text"))

        part = TaskContext.get().partitionId()
        for number, chunk in enumerate(segments(texts(), chunk_bytes)):
            found, n = told(chunk, held)
            pair = (found >> 32).astype(np.int32)
            cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))), [len(pair)]))
            rows = len(cuts) - 1
            yield pa.RecordBatch.from_arrays([pa.array(pair[cuts[:-1]]), pa.array(np.full(rows, part, np.int32)), pa.array(np.full(rows, number, np.int32)), *(pa.array([_planes(x[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (found.astype(np.uint32), n))], names=["pair", "part", "chunk", "low", "n"])

    return run


def _count_words(batches):
    """An Arrow map from texts to partial counts of words; the end is a null word."""
    words, ends = Counter(), 0

    def rows(words, n):
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    for b in common.pieces(batches, 1 << 20):
        ends += b.num_rows
        for t in common.utf8(b.column("text")):
            words.update(common.tokens(t))
        if len(words) > 300_000:
            yield rows(list(words), list(words.values()))
            words.clear()
    if ends:
        yield rows([*words, None], [*words.values(), ends])


# ---- estimates

def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series past ten, recurrence below."""
    x = np.asarray(x, np.float64)
    low = np.maximum(0, np.ceil(10 - x))
    shift = np.zeros_like(x)
    for k in range(10):
        shift += np.where(k < low, np.log(np.where(k < low, x + k, 1)), 0)
    y = x + low
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: lgamma(n + 1/2) and lgamma(n + 1) of small counts, which most are.
_TABLE = 1 << 14
_HALF, _WHOLE = lgamma(np.arange(_TABLE) + 0.5), lgamma(np.arange(_TABLE) + 1.0)


def _looked(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(n, _TABLE - 1).astype(np.int64)]
    big = n >= _TABLE
    if big.any():
        out[big] = lgamma(n[big] + shift)
    return out


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen at each of the 255 nodes of a byte (node 1 is its first bit), for rows of byte counts."""
    n = np.zeros((len(counts), 512))
    n[:, 256:] = counts
    for level in range(7, -1, -1):
        a = 1 << level
        n[:, a : 2 * a] = n[:, 2 * a : 4 * a].reshape(len(counts), a, 2).sum(axis=2)
    return n[:, 0:512:2][:, :256], n[:, 1:512:2][:, :256]


def decisions(alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes on the paths of some bytes (in order), and where the bytes under each begin, divide and end."""
    node, cuts = [], []
    for level in range(8):
        prefix = np.unique(alphabet >> (8 - level))
        node.append(1 << level | prefix)
        cuts.append(np.searchsorted(alphabet, np.stack([(2 * prefix + k) << (7 - level) for k in range(3)])))
    return np.concatenate(node), np.concatenate(cuts, axis=1)


def _at_nodes(counts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen at each node of `decisions`, for rows of its bytes' counts."""
    n = np.zeros((len(counts), counts.shape[1] + 1))
    np.cumsum(counts, axis=1, out=n[:, 1:])
    low, middle, high = (n[:, c] for c in cuts)
    return middle - low, high - middle


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _looked(_HALF, a, 0.5) + _looked(_HALF, b, 0.5) - _looked(_WHOLE, a + b, 1.0) - np.log(np.pi)


def _ones(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates of a one after a zeros and b ones; above a half, minus the estimate of a zero, so that neither side is rounded away."""
    return np.where(b <= a, b + 0.5, -a - 0.5) / (a + b + 1)


def _sides(v: np.ndarray) -> np.ndarray:
    """Probabilities of a zero and of a one, from what `_ones` gives."""
    v = v.astype(np.float64)
    return np.stack((np.where(v > 0, 1 - v, -v), np.where(v > 0, v, 1 + v)))


def _prices(p: np.ndarray) -> np.ndarray:
    """log10 probability of each byte, from those of its decisions (2 x rows x nodes)."""
    out = np.zeros((p.shape[1], 256))
    for level in range(8):
        out += np.log10(p[(SYM >> (7 - level)) & 1, :, (1 << level) | (SYM >> (8 - level))].T)
    return out


# ---- trees

@dataclass
class Tree:
    """Contexts by depth (0 is the tree's own root) as numbers, youngest byte lowest; arrays are rows of contexts by the nodes that the tree's bytes pass.

    No count reaches any other node, so its weight is one everywhere.
    """

    ctx: list
    parent: list
    first: np.ndarray  # number of each depth's first state
    step: np.ndarray  # next state by state and older byte, or -1
    own: list  # estimates of each context, of its pooled extensions, and the weight of stopping at it
    rest: list
    stop: list
    weighted: np.ndarray  # log weighted probability of the root, by number of the node
    alphabet: np.ndarray  # bytes that it may price, in order
    node: np.ndarray  # numbers of the nodes


def _sums(rows: np.ndarray, parent: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by parent."""
    out = np.zeros((size, rows.shape[1]))
    if len(rows):
        order = np.argsort(parent, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], np.diff(parent[order]) > 0)))
        out[parent[order][start]] = np.add.reduceat(rows[order], start, axis=0)
    return out


def tree(entries: list[tuple[np.ndarray, np.ndarray]], alphabet: np.ndarray = SYM) -> Tree:
    """The tree of counts, weighed bottom up; alphabet: the bytes that are counted or will be priced, in order.

    entries: for each depth the (context << 8 | byte) keys of its own contexts,
    sorted, and counts; a context's shorter one is among those before.
    """
    depth = len(entries) - 1
    ctx = [np.zeros(1, np.int64)] + [np.unique(k >> 8) for k, _ in entries[1:]]
    first = np.concatenate(([0], np.cumsum([len(c) for c in ctx])))
    counts, (node, cuts) = [], decisions(alphabet)
    for d, (k, n) in enumerate(entries):
        c = np.zeros((len(ctx[d]), len(alphabet)))
        c[np.searchsorted(ctx[d], k >> 8), np.searchsorted(alphabet, k & 255)] = n
        counts.append(c)
    parent = [None] + [np.searchsorted(ctx[d - 1], ctx[d] & ((1 << (8 * (d - 1))) - 1)) for d in range(1, depth + 1)]
    step = np.full((int(first[max(depth, 1)]), 256), -1, np.int32)  # the deepest have no extensions
    for d in range(1, depth + 1):
        step[first[d - 1] + parent[d], ctx[d] >> (8 * (d - 1))] = first[d] + np.arange(len(ctx[d]))
    stop, own, rest = [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1)
    below = above = weighted = None
    for d in range(depth, -1, -1):
        stop[d], own[d] = np.ones((len(ctx[d]), len(node)), np.float32), np.empty((len(ctx[d]), len(node)), np.float32)
        weighted = np.empty((len(ctx[d]), len(node)))
        if d < depth:
            left = counts[d] - _sums(counts[d + 1], parent[d + 1], len(ctx[d]))
            below, counts[d + 1] = _sums(above, parent[d + 1], len(ctx[d])), None
            rest[d] = np.empty((len(ctx[d]), len(node)), np.float32)
        for at in range(0, len(ctx[d]), 2048):
            s = slice(at, at + 2048)
            a, b = _at_nodes(counts[d][s], cuts)
            mine = _kt(a, b)
            own[d][s] = _ones(a, b)
            weighted[s] = mine
            if d < depth:
                a, b = _at_nodes(left[s], cuts)
                rest[d][s] = _ones(a, b)
                both = np.logaddexp(mine, _kt(a, b) + below[s]) - np.log(2)
                stop[d][s] = np.exp(mine - np.log(2) - both)
                weighted[s] = both
        above = weighted
    root = np.zeros(256)
    root[node] = weighted[0]
    return Tree(ctx, parent, first, step, own, rest, stop, root, alphabet, node)


def _mixed(p: np.ndarray, above: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Predictions mixed with those of shorter contexts: (estimate, weight of stopping) by node, the longest first."""
    for own, stop in above:
        p = stop * _sides(own)[:, None, :] + (1 - stop) * p
    return p


def prices(t: Tree, state: np.ndarray, symbol: np.ndarray, above: list[tuple[np.ndarray, np.ndarray]] = ()) -> np.ndarray:
    """log10 probability of each symbol in its state of a tree, whose root stands below the contexts `above`."""
    order = np.argsort(state, kind="stable")
    state, symbol, out = state[order], symbol[order].astype(np.int64), np.empty(len(order), np.float32)
    above = [(own[t.node], stop[t.node]) for own, stop in above]
    level = np.arange(8)
    path = np.searchsorted(t.node, (1 << level) | (t.alphabet[:, None] >> (8 - level)))  # of each byte of the alphabet
    bit = (t.alphabet[:, None] >> (7 - level)) & 1
    for d in range(len(t.ctx)):
        asked = np.unique(state[slice(*np.searchsorted(state, t.first[d : d + 2]))])
        for at in range(0, len(asked), 2048):
            part = asked[at : at + 2048]
            up = part - t.first[d]
            p = _sides(t.own[d][up])
            if d < len(t.ctx) - 1:
                w = t.stop[d][up]
                p = w * p + (1 - w) * _sides(t.rest[d][up])
            for e in range(d - 1, -1, -1):
                up = t.parent[e + 1][up]
                w = t.stop[e][up]
                p = w * _sides(t.own[e][up]) + (1 - w) * p
            logs = np.log10(_mixed(p, above))
            mine = slice(np.searchsorted(state, part[0]), np.searchsorted(state, part[-1], side="right"))
            row, x = np.searchsorted(part, state[mine]), np.searchsorted(t.alphabet, symbol[mine])
            out[order[mine]] = sum(logs[bit[x, k], row, path[x, k]] for k in level)
    return out


def entries(low: np.ndarray, n: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """What `tree` takes, of one pair's windows: three older bytes, oldest last, and the byte itself; contexts of fewer than `least` are left to be pooled."""
    seen = np.bincount(low & 255, n, 256)
    out = [(np.flatnonzero(seen), seen[seen > 0])]
    for d in range(1, DEPTH - 1):
        prefix = (low >> np.uint32(8 * (DEPTH - 1 - d))).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        total = np.add.reduceat(n, start)
        kept = np.repeat(total >= least, np.diff(np.append(start, len(low))))
        p, symbol, m = prefix[kept], (low[kept] & 255).astype(np.int64), n[kept]
        context = np.zeros(len(p), np.int64)
        for k in range(d):
            context |= ((p >> (8 * (d - 1 - k))) & 255) << (8 * k)
        keys, where = np.unique(context << 8 | symbol, return_inverse=True)
        out.append((keys, np.bincount(where, m, len(keys))))
    return out


def bytes_of(low: np.ndarray) -> np.ndarray:
    """The bytes that end some windows, in order."""
    return np.flatnonzero(np.bincount(low & 255, minlength=256))


def states(t: Tree, low: np.ndarray) -> np.ndarray:
    """The deepest state of each window."""
    state, live = np.zeros(len(low), np.int64), np.arange(len(low))
    for k in range(len(t.ctx) - 1):
        deeper = t.step[state[live], (low[live] >> np.uint32(8 * (DEPTH - 2 - k))) & 255]
        found = deeper >= 0
        live = live[found]
        state[live] = deeper[found]
    return state


# ---- subtrees and upper levels

MERGED = "pair int, low binary, n binary, parts array<int>, chunks array<int>, sizes array<long>, places binary"
SUBTREES = "pair int, low binary, n binary, counts binary, weighted binary"


def _arrays(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [_numbers(x, kind) for x in column.to_pylist()]


def _merge(told: pa.Table) -> pa.Table:
    """One row of a pair's chunks: their distinct windows with training counts, and where each chunk's stand among them."""
    lows = _arrays(told.column("low"), np.uint32)
    low, where = np.unique(np.concatenate(lows), return_inverse=True)
    n = np.bincount(where, np.concatenate(_arrays(told.column("n"), np.uint32)), len(low)).astype(np.int64)
    values = (told.column("pair")[0].as_py(), _planes(low), _planes(n), told.column("part").to_pylist(), told.column("chunk").to_pylist(), [len(x) for x in lows], _planes(where.astype(np.uint32)))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=["pair", "low", "n", "parts", "chunks", "sizes", "places"])


def _weighed(least: int):
    """One row of a pair's merged rows: all distinct windows with counts, and the subtree's byte counts and weight."""

    def run(merged: pa.Table) -> pa.Table:
        if merged.num_rows == 1:
            low, n = (_arrays(merged.column(c), k)[0] for c, k in (("low", np.uint32), ("n", np.int64)))
        else:
            low, where = np.unique(np.concatenate(_arrays(merged.column("low"), np.uint32)), return_inverse=True)
            n = np.bincount(where, np.concatenate(_arrays(merged.column("n"), np.int64)), len(low)).astype(np.int64)
        counts = np.bincount(low & 255, n, 256)
        weighted = tree(entries(low, n.astype(np.float64), least), bytes_of(low)).weighted if counts.any() else np.zeros(256)
        values = (merged.column("pair")[0].as_py(), _planes(low), _planes(n), counts.astype(np.int64).tobytes(), weighted.tobytes())
        return pa.table([pa.array([v], k) for v, k in zip(values, [pa.int32(), *[pa.binary()] * 4])], names=["pair", "low", "n", "counts", "weighted"])

    return run


def _weighed_alone(least: int):
    """`_merge` and `_weighed` of a pair whose chunks one task has."""

    def run(told: pa.Table) -> pa.Table:
        merged = _merge(told)
        whole = _weighed(least)(merged)
        return merged.append_column("counts", whole.column("counts")).append_column("weighted", whole.column("weighted"))

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """Sums of the counts and weights of one youngest byte's subtrees."""
    total = lambda c, kind: np.sum([np.frombuffer(x, kind) for x in rows.column(c).to_pylist()], axis=0)
    return pa.table({"first": pa.array([rows.column("first")[0].as_py()], pa.int32()), "counts": pa.array([total("counts", np.int64).tobytes()], pa.binary()), "weighted": pa.array([total("weighted", np.float64).tobytes()], pa.binary())})


@dataclass
class Upper:
    """Estimates and weights of stopping of the empty context (row 256) and of each single byte, by node; seen: which bytes are nodes."""

    own: np.ndarray
    stop: np.ndarray
    seen: np.ndarray

    def above(self, byte: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.own[k], self.stop[k]) for k in ([byte] if self.seen[byte] else []) + [256]]


def upper(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Upper:
    """The two upper levels, of (youngest byte, its byte counts, sum of its subtrees' weights)."""
    counts, total = np.zeros((257, 256)), np.zeros((257, 256))
    for byte, n, w in rows:
        counts[byte], total[byte] = n, w
    counts[256] = counts[:256].sum(axis=0)
    a, b = _bits(counts)
    mine, both = _kt(a, b), np.empty((257, 256))
    both[:256] = np.logaddexp(mine[:256], total[:256]) - np.log(2)
    total[256] = both[:256][counts[:256].any(axis=1)].sum(axis=0)
    both[256] = np.logaddexp(mine[256], total[256]) - np.log(2)
    return Upper(_ones(a, b), np.exp(mine - np.log(2) - both), counts.any(axis=1))


PRICED = "part int, chunk int, pair int, price binary"


def _price(shared, least: int):
    """An Arrow map from subtrees to the prices of each chunk's windows."""

    def run(batches):
        top: Upper = shared.value
        for b in batches:
            for row in range(b.num_rows):
                pair, asked, low, n, parts, chunks, sizes, places = (b.column(c)[row].as_py() for c in ("pair", "asked", "low", "n", "parts", "chunks", "sizes", "places"))
                low, n, places = _numbers(low, np.uint32), _numbers(n, np.int64), _numbers(places, np.uint32)
                asked, above = low if asked is None else _numbers(asked, np.uint32), top.above(pair >> 8)
                if n.any():
                    t = tree(entries(low, n.astype(np.float64), least), bytes_of(low))
                    price = prices(t, states(t, asked), asked & 255, above)
                else:  # nothing is known below the contexts above
                    price = _prices(_mixed(np.full((2, 1, 256), 0.5), above))[0, asked & 255].astype(np.float32)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(chunks, pa.int32()), pa.array([pair] * len(parts), pa.int32()), _binaries(price[places], cuts)], names=["part", "chunk", "pair", "price"])

    return run


# ---- the operator

def priced(docs: DataFrame, least: int = LEAST, chunk_bytes: int = CHUNK, salts: int = 1) -> str:
    """Path of the prices of all windows, by task and chunk of docs (held_out, text)."""
    spark = docs.sparkSession
    rows_ = docs.select("held_out", "text").mapInArrow(_tell(chunk_bytes), TOLD)
    if salts == 1:
        merged = subtrees = common.written(rows_.groupBy("pair").applyInArrow(_weighed_alone(least), f"{MERGED}, counts binary, weighted binary"), "subtrees")
    else:
        dealt = rows_.withColumn("salt", F.pmod("part", F.lit(salts)))
        merged = common.written(dealt.groupBy("pair", "salt").applyInArrow(_merge, MERGED), "merged")
        subtrees = common.written(merged.select("pair", "low", "n").groupBy("pair").applyInArrow(_weighed(least), SUBTREES), "subtrees")
    sums = subtrees.select(F.shiftright("pair", 8).alias("first"), "counts", "weighted").groupBy("first").applyInArrow(_summed, "first int, counts binary, weighted binary")
    rows = [(r["first"], np.frombuffer(r["counts"], np.int64), np.frombuffer(r["weighted"], np.float64)) for r in sums.collect()]
    shared = spark.sparkContext.broadcast(upper([r for r in rows if r[1].any()]))
    asks = merged.select("pair", "parts", "chunks", "sizes", "places", (F.lit(None).cast("binary") if salts == 1 else F.col("low")).alias("asked"), *(["low", "n"] if salts == 1 else []))
    asks = asks if salts == 1 else asks.join(subtrees.select("pair", "low", "n"), "pair")
    path = common.new_path(spark, "prices")
    out = asks.mapInArrow(_price(shared, least), PRICED).repartition("part").sortWithinPartitions("part", "chunk", "pair")
    out.write.option("parquet.block.size", 8 << 20).partitionBy("part").parquet(path)
    return path


def _chunk_prices(path: str, part: int):
    """A function from a chunk's number to the prices of its distinct windows, in their order."""
    where, root = fs.FileSystem.from_uri(f"{path}/part={part}")
    found = ds.dataset(root, filesystem=where, format="parquet")

    def of(chunk: int) -> np.ndarray:
        rows = found.to_table(columns=["pair", "price"], filter=ds.field("chunk") == chunk).sort_by("pair")
        return np.frombuffer(b"".join(rows.column("price").to_pylist()), np.float32)

    return of


def score(docs: DataFrame, fold: int = 7, held: int = 2, least: int = LEAST, frequent: int = FREQUENT, chunk_bytes: int = CHUNK, salt_bytes: int = 4 << 30, stable: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    docs is read twice and must give the same rows in the same order to the same
    tasks, as a scan of files does: say so with `stable`; else it is written first.
    A difference is an error, never a wrong score.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text", (common.doc_hash_mod("doc_id", fold) == held).alias("held_out"))
    docs = docs if stable else common.written(docs, "texts")
    parts = docs.where(~F.col("held_out")).select("text").mapInArrow(_count_words, "word binary, n long")
    words = common.written(parts.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    vocabulary = words.where("word is not null")
    ends = words.where("word is null").agg(F.sum("c")).first()[0] or 0
    kinds, tokens = vocabulary.agg(F.count("*"), F.sum("c")).first()
    total, kinds = (tokens or 0) + ends, kinds + (ends > 0)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = priced(docs, least, chunk_bytes, size // salt_bytes + 1)
    often = max(1, -(-total // frequent))
    bottom = total + kinds + 1
    cost = lambda c: math.log10((c + 1) / bottom)
    common_words = sc.broadcast({bytes(r.word): cost(r.c) for r in vocabulary.where(F.col("c") >= often).collect()})
    end = cost(ends)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("rare", T._parse_datatype_string("array<struct<word:binary,k:bigint>>"))))])

    def run(batches):
        known, open_ = common_words.value, {}

        def judge(text: bytes):
            """n_tokens, n_known and base score of the frequent words, and the other words with how often."""
            words, hits, sum_, rare, times = common.tokens(text), int(ends > 0), end, [], []
            for w, k in Counter(words).items():
                if (c := known.get(w)) is None:
                    rare.append(w)
                    times.append(k)
                else:
                    hits, sum_ = hits + k, sum_ + k * c
            return len(words) + 1, hits, sum_, rare, times

        def texts():
            row = 0
            for b in common.pieces(batches):
                for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), common.utf8(b.column("text"))):
                    open_[row] = [i, h, *judge(t), 0.0]
                    row += 1
                    yield t

        part = TaskContext.get().partitionId()
        of = None
        for number, chunk in enumerate(segments(texts(), chunk_bytes)):
            of = of or _chunk_prices(path, part)
            sums = priced_sums(chunk, of(number))
            done = []
            for s, v in zip(chunk, sums.tolist()):
                open_[s.row][-1] += v
                if s.last:
                    done.append(open_.pop(s.row))
            if done:
                i, h, n, hits, base, rare, times, value = zip(*done)
                cuts = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in rare]))), pa.int32())
                words = pa.StructArray.from_arrays([pa.array([w for x in rare for w in x], pa.binary()), pa.array([k for x in times for k in x], pa.int64())], ["word", "k"])
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip((i, h, n, hits, base, value), kinds_)), pa.ListArray.from_arrays(cuts, words)], names=schema.names)

    kinds_ = to_arrow_schema(schema).types
    # the written table fixes the row numbers
    rows = common.written(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    left = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    judged = left.join(vocabulary.where(F.col("c") < often), "word", "left").select("row", "k", F.coalesce("c", F.lit(0)).alias("c"))
    sums = judged.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10((F.col("c") + 1) / F.lit(float(bottom)))).alias("add"))
    zero = lambda c, z: F.coalesce(c, F.lit(z))
    return rows.join(sums, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("more", 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + zero("add", 0.0)).alias("base_score"), "score")
