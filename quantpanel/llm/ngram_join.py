"""N-gram Jaccard join: exact components of documents whose word-shingle sets are similar enough, by signature trees.

Plan.
1. Profile: every text becomes its set size and a 128-bit hash of its set. Equal sets form one class at once (its smallest id).
2. Routing, exact: sets of sizes a, b with Jaccard >= t differ in at most D = (a + b)(1 - t) / (1 + t) shingles. For each range of
   sizes the hash space is cut into k > D parts; two linked sets agree wholly on at least one part. So each set sends one key a part,
   and sets that share no key cannot be linked. Some spare parts allow for parts that are empty, which need not be sent then.
   Shingles of common passages would make keys that many unlike sets share. As two linked sets differ in at most D shingles
   within any fixed part of the universe, a set that has enough other shingles is cut into parts without the common ones; sets
   near or below that limit send the keys of all their shingles (too), so two linked sets always meet in one of the two ways.
   Inside a batch, equal keys are collapsed before the shuffle, so a group of copies sends few rows; the rest is sent as sorted,
   packed arrays, one a batch and routing task. Sets that share keys form candidate clusters (connected components of shared keys).
   Of equal sets one stands for all from here on, and clusters of one such class have nothing to join.
   Unlike sets share a key now and then, and the more documents there are, the longer are the chains of them: so the sets of larger
   clusters send their keys once more, with counts of their shingles by bucket. The counts of two sets differ in no more than the
   sets do, so only pairs whose counts are near enough stay together, and texts that link with nothing are not moved.
3. Join: each cluster is gathered once and joined by a signature tree: nodes hold OR-combined token bitmaps, size ranges
   and the largest number of bitmap collisions. A dual traversal prunes pairs of nodes by the largest overlap possible between
   them, and pairs of nodes that already are one component; what remains is compared exactly. Before that, a few central sets
   (those of the most shared shingles) are compared with all others, as copies usually are near one original and not near each
   other. A cluster too large for a task is cut into blocks by hash: each block nominates central sets; the best of the cluster go
   to every block, which is then joined; and where a cluster still is in several components, its sets are dealt anew, into blocks of
   a size class. The roots' size ranges then prune the pairs of blocks: only those of one class or of neighbouring ones are joined, known
   components costing nothing. So nothing is lost and copies do not meet pairwise.
4. The links found (a forest a task) give the components; members of equal sets follow their class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantpanel.llm.common import cut, drop_shuffles, forget, give_back, mix64, remove, sieve, stored, text_slices, union_find
from quantpanel.llm.components import components
from quantpanel.session import ship_package

#: Odd 64-bit multipliers for the words of a shingle, from a rule.
FACTORS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: A task joins about so many sets or code points of a cluster at once.
BLOCK_ROWS, BLOCK_CHARS = 4_000, 12_000_000
LEAF = 8
#: A mapper looks at about so many shingles together.
BATCH_TOKENS = 2_500_000
#: Central sets tried in a block, and those that all blocks of a large cluster get.
CENTRES, SHARED_CENTRES = 8, 16
#: A routing task gets the keys of about so many shingles (some 3 million keys). Linked sets share many keys and so meet in most of these
#: tasks; larger ones say the same less often.
PART_TOKENS = 6_000_000
#: Common shingles: found where HEAVY_BATCH sets of a batch share one, the HEAVY_KEPT most common of them, as flags of slots. A hint
#: for routing of bounded size; any set of flags gives the same result.
HEAVY_BATCH, HEAVY_KEPT, HEAVY_SLOTS, HEAVY_STEPS = 3, 400_000, 1 << 23, 1 << 16
KEY_BITS = 56  # of a routing key that are sent; keys that agree in these alone only bring unlike sets together
#: Clusters of more sets than this are told apart by counts; pairs that are compared for one key and in one task at most (beyond that, sets
#: that share a key stay together); bytes compared at once.
CLOSE_ROWS, KEY_PAIRS, TASK_PAIRS, COMPARED = 50, 2_000_000, 30_000_000, 16_000_000
RICH = 1.5  # shingles a part that are not common, for a set to be cut without the common ones


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the n-word shingles; the whole sequence where it has fewer words; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total += hashed[i : len(words) - width + 1 + i] * FACTORS[i]
    return np.unique(mix64(total))


@cache
def size_classes(percent: int, largest: int) -> tuple[int, ...]:
    """Lower bounds of the classes: linked sets lie in one class or in two neighbouring ones."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return tuple(bounds)


@cache
def parts_of(percent: int, low: int, high: int, sparse: bool) -> tuple[int, int, int]:
    """(parts, spare, most differences) for pairs whose smaller set has a size in low..high-1; no parts where only equal sets link."""
    a = high - 1
    differ = (a + a * 100 // percent) * (100 - percent) // (100 + percent)
    if not differ:
        return 0, 0, 0
    k = differ + 1
    spare = 1 + math.ceil(2 * k * math.exp(-RICH if sparse else -low / k))
    return k + spare, spare, differ


def _part_keys(tokens: np.ndarray, k: int, spare: int, name: int) -> np.ndarray:
    """A key for each part of the hash space that holds tokens, and for the empty ones if there are more of these than spare."""
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(tokens), dtype=np.uint64)])
    edges = np.searchsorted(tokens, ((np.arange(k, dtype=np.uint64) << np.uint64(32)) // np.uint64(k)) << np.uint64(32))
    edges = np.append(edges, len(tokens))
    full = np.flatnonzero(np.diff(edges))
    if k - len(full) > spare:
        full = np.arange(k)
    sums = running[edges[full + 1]] - running[edges[full]]
    own_name = np.uint64(name * int(FACTORS[41]) % 2**64)
    return mix64(sums * FACTORS[40] + own_name + full.astype(np.uint64) * FACTORS[42])


def keys_of(tokens: np.ndarray, percent: int, heavy: np.ndarray | None = None) -> np.ndarray:
    """The routing keys of a set: of the scheme of its own size class and of the class below."""
    n = len(tokens)
    bounds = size_classes(percent, max(64, 1 << n.bit_length()))
    own = int(np.searchsorted(bounds, n, "right")) - 1
    light = tokens if heavy is None else tokens[~heavy[(tokens % np.uint64(HEAVY_SLOTS)).astype(np.int64)]]
    out = []
    for scheme in (own - 1, own):
        if scheme < 0:
            continue
        k, spare, differ = parts_of(percent, bounds[scheme], bounds[scheme + 1], True)
        if not k:
            continue
        enough = int(RICH * k)
        if len(light) >= enough:
            out.append(_part_keys(light, k, spare, 2 * scheme))
        if len(light) < enough + differ:
            k, spare, _ = parts_of(percent, bounds[scheme], bounds[scheme + 1], False)
            out.append(_part_keys(tokens, k, spare, 2 * scheme + 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# ------------------------------------------------------------------ passes over the documents


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _profile(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of each document (id, n, s0, s1, doc true); of each shingle that several sets share (null, sets, shingle, 0, false), counted
    over some thousand documents at a time."""
    forget()
    every: list[np.ndarray] = []

    def shared() -> Iterator[pa.RecordBatch]:
        token, times = np.unique(np.concatenate(every), return_counts=True)
        common = times >= HEAVY_BATCH
        token, times = token[common].view(np.int64), times[common].astype("i8")
        for at in range(0, len(token), 100_000):
            part = token[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array(times[at : at + 100_000]), pa.array(part), pa.array(np.zeros(len(part), "i8")), pa.array([False] * len(part))], ["id", "n", "s0", "s1", "doc"])
        every.clear()

    held = 0
    for part in text_slices(batches):
        rows = []
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            tokens = shingles(text, n)
            both = (int(mix64(tokens).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix64(tokens + FACTORS[50])))) if len(tokens) else (0, 0)
            rows.append((doc, len(tokens), _signed(both[0]), _signed(both[1])))
            every.append(tokens)
            held += len(tokens)
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([True] * len(rows))], ["id", "n", "s0", "s1", "doc"])
        if held > BATCH_TOKENS:
            yield from shared()
            held = 0
    if every:
        yield from shared()


def _bytes(x: np.ndarray) -> bytes:
    """Numbers of 64 bits by their first, second, ... bytes, compressed: the high ones of small numbers take no room."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T), 1)


def _numbers(data) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def packed(key: np.ndarray, node: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, first, keys, nodes): keys sorted and as differences, nodes as differences from the first; a part is a range of keys."""
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order].view(np.uint64)
    edge = np.searchsorted(key, ((np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts)) << np.uint64(32))
    edge = [0, *edge.tolist(), len(key)]
    key = key >> np.uint64(64 - KEY_BITS)
    step = np.diff(key, prepend=np.uint64(0))
    rows = []
    for p, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        if b > a:
            step[a], first = key[a], node[a:b].min()
            rows.append((p, int(first.view(np.int64)), _bytes(step[a:b]), _bytes(node[a:b] - first)))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "first", "keys", "nodes"])


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys and nodes of all rows."""
    key, node = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for i in range(batch.num_rows):
        key.append(_numbers(batch.column("keys")[i].as_buffer()).cumsum(dtype=np.uint64))
        node.append(_numbers(batch.column("nodes")[i].as_buffer()) + np.int64(batch.column("first")[i].as_py()).view(np.uint64))
    return np.concatenate(key), np.concatenate(node).view(np.int64)


def _route(batches: Iterator[pa.RecordBatch], n: int, percent: int, heavy_bits, parts: int) -> Iterator[pa.RecordBatch]:
    heavy = np.unpackbits(np.frombuffer(heavy_bits.value, np.uint8)).astype(bool)
    found: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    known: dict[bytes, int] = {}

    def collapsed() -> Iterator[pa.RecordBatch]:
        """Those that share a key meet under their first one's name instead, so a group of copies sends few rows."""
        key, node = np.concatenate(found), np.concatenate(nodes)
        found.clear()
        nodes.clear()
        known.clear()
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        head = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        lead = node[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        ties = np.unique(np.stack([lead[~head], node[~head]], 1), axis=0)
        ties = ties[ties[:, 0] != ties[:, 1]]
        named = mix64(ties[:, 0].view(np.uint64) + FACTORS[51])
        leads = np.unique(ties[:, 0])
        key = np.concatenate([key[head], named, mix64(leads.view(np.uint64) + FACTORS[51])])
        yield packed(key, np.concatenate([node[head], ties[:, 1], leads]), parts)

    held = 0
    for part in text_slices(batches):
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            tokens = shingles(text, n)
            if doc is None or not len(tokens):
                continue
            first = known.setdefault(xxhash.xxh3_128_digest(tokens), doc)
            if first is not doc:
                continue  # an equal set has sent its keys; equal sets are one class anyway
            found.append(keys_of(tokens, percent, heavy))
            nodes.append(np.full(len(found[-1]), doc, np.int64))
            held += len(tokens)
        if held > BATCH_TOKENS:
            yield from collapsed()
            held = 0
    if found:
        yield from collapsed()


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (node, smallest node of its component) of the graph of a[i] - b[i]; two columns."""
    if not len(a):
        return np.zeros((0, 2), np.int64)
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    find, join = union_find(len(names))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        join(x, y)
    roots = np.array([find(i) for i in range(len(names))])
    moved = roots != np.arange(len(names))
    return np.stack([names[moved], names[roots[moved]]], 1)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that share a key, as a forest. A partition's keys are whole; it has a bounded number of rows."""
    parts = [unpacked(b) for b in batches]
    if not parts:
        return
    key, node = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    same = (key[1:] == key[:-1]) & (node[1:] != node[:-1])
    edges = forest(node[1:][same], node[:-1][same])
    del key, node, order, same, parts
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def counts(tokens: np.ndarray) -> np.ndarray:
    """Tokens by bucket; the number of buckets follows that of the tokens. Wide counts are folded for a comparison with narrow ones."""
    width = width_of(len(tokens))
    return np.minimum(np.bincount((tokens % np.uint64(width)).astype(np.int64), minlength=width), 255).astype(np.uint8)


def width_of(n: int) -> int:
    return max(16, 1 << (n // 6).bit_length())


def _route_counted(batches: Iterator[pa.RecordBatch], n: int, percent: int, heavy_bits, parts: int) -> Iterator[pa.RecordBatch]:
    """As _route(), but each set sends its own keys, and once a routing task its size and counts: (part, first, keys, nodes, ids, sizes, counts).

    A size of 0 stands for an id with several sets, of which no counts are told."""
    heavy = np.unpackbits(np.frombuffer(heavy_bits.value, np.uint8)).astype(bool)
    found: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    own: dict[int, np.ndarray] = {}
    size: dict[int, int] = {}

    def made() -> pa.RecordBatch:
        out = packed(np.concatenate(found), np.concatenate(nodes), parts)
        columns = []
        for i in range(out.num_rows):
            ids = np.unique(unpacked(out.slice(i, 1))[1])
            told = np.concatenate([own[x] for x in ids.tolist()])
            columns.append((_bytes(ids), _bytes(np.array([size[x] for x in ids.tolist()])), zstandard.compress(told, 1)))
        for kept in (found, nodes, own, size):
            kept.clear()
        names = ["ids", "sizes", "counts"]
        columns = [pa.array(c, pa.binary()) for c in zip(*columns, strict=True)] or [pa.array([], pa.binary())] * 3
        return pa.RecordBatch.from_arrays([*out.columns, *columns], [*out.schema.names, *names])

    held = 0
    for part in text_slices(batches):
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            tokens = shingles(text, n)
            if doc is None or not len(tokens):
                continue
            told = counts(tokens)
            if doc in own and not (size[doc] == len(tokens) and np.array_equal(own[doc], told)):
                own[doc], size[doc] = told[:0], 0
            elif doc not in own:
                own[doc], size[doc] = told, len(tokens)
            found.append(keys_of(tokens, percent, heavy))
            nodes.append(np.full(len(found[-1]), doc, np.int64))
            held += len(tokens)
        if held > BATCH_TOKENS:
            yield made()
            held = 0
    if found:
        yield made()


class Counted:
    """Sets known by their sizes and counts alone."""

    def __init__(self, size: np.ndarray, told: list[np.ndarray]) -> None:
        self.size, self.width = size, np.array([len(x) for x in told])
        self.row, self.rows = np.zeros(len(size), np.int64), {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.rows[w] = np.stack([told[i] for i in at.tolist()]) if w else None

    def near(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sets of a pair may be linked; False is sure."""
        out = np.ones(len(i), bool)
        known = (self.size[i] > 0) & (self.size[j] > 0)
        wide, narrow = np.where(self.width[i] >= self.width[j], i, j), np.where(self.width[i] >= self.width[j], j, i)
        for w, v in np.unique(np.stack([self.width[wide[known]], self.width[narrow[known]]], 1), axis=0).tolist():
            which = np.flatnonzero(known & (self.width[wide] == w) & (self.width[narrow] == v))
            for at in np.array_split(which, max(1, len(which) * w // COMPARED)):
                a, b = self.rows[w][self.row[wide[at]]], self.rows[v][self.row[narrow[at]]]
                if w > v:
                    a = a.reshape(len(at), -1, v).sum(1, dtype=np.int32)
                differ = np.abs(np.subtract(a, b, dtype=np.int32 if w > v else np.int16)).sum(1, dtype=np.int64)
                out[at] = differ * (100 + percent) <= (100 - percent) * (self.size[wide[at]] + self.size[narrow[at]])
        return out


def _meet_counted(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """As _meet(), but only nodes whose counts are near enough, pair by pair."""
    parts, told, size = [], {}, {}
    for batch in batches:
        parts.append(unpacked(batch))
        for i in range(batch.num_rows):
            ids, sizes = (_numbers(batch.column(c)[i].as_buffer()).view(np.int64).tolist() for c in ("ids", "sizes"))
            every = np.frombuffer(zstandard.decompress(batch.column("counts")[i].as_buffer()), np.uint8)
            at = 0
            for x, n in zip(ids, sizes, strict=True):
                own = every[at : at + (width_of(n) if n else 0)]
                at += len(own)
                if x in told and not (size[x] == n and np.array_equal(told[x], own)):
                    own, n = own[:0], 0  # an id with several sets
                told[x], size[x] = own, n
    if not told:
        return
    key, node = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, node = np.unique(node, return_inverse=True)
    sets = Counted(np.array([size[x] for x in names.tolist()]), [told[x] for x in names.tolist()])
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
    key, node = key[first], node[first]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(head, len(key)))
    del parts, told, size, key, order, first
    find, join = union_find(len(names))

    def compared(i: np.ndarray, j: np.ndarray) -> None:
        hold = sets.near(i, j, percent)
        for x, y in zip(i[hold].tolist(), j[hold].tolist(), strict=True):
            join(x, y)

    # most keys are shared by a few sets
    pairs = [np.zeros((0, 2), np.int64)]
    for n in range(2, 9):
        at = head[many == n]
        pairs += [np.stack([node[at + x], node[at + y]], 1) for x in range(n) for y in range(x + 1, n)]
    compared(*np.unique(np.concatenate(pairs), axis=0).T)
    del pairs
    left = TASK_PAIRS
    by_size = np.flatnonzero(many > 8)
    for g in by_size[np.argsort(many[by_size], kind="stable")].tolist():
        own = node[head[g] : head[g] + many[g]]
        root = np.array([find(x) for x in own.tolist()])
        own = own[np.argsort(root, kind="stable")]
        root = np.sort(root)
        if root[0] == root[-1]:
            continue
        beyond = np.searchsorted(root, root, "right")  # where the sets of later components begin
        pairs = int((len(own) - beyond).sum())
        left -= pairs if pairs <= KEY_PAIRS else 0
        if pairs > KEY_PAIRS or left < 0:
            for x in own[1:].tolist():
                join(int(own[0]), x)
            continue
        i = np.repeat(np.arange(len(own)), len(own) - beyond)
        j = np.arange(pairs) - np.repeat(np.cumsum(len(own) - beyond) - len(own), len(own) - beyond)
        compared(own[i], own[j])
    roots = np.array([find(i) for i in range(len(names))])
    moved = roots != np.arange(len(names))
    edges = [pa.array(names[moved]), pa.array(names[roots[moved]])]
    del sets, node
    give_back()
    yield pa.RecordBatch.from_arrays(edges, ["a", "b"])


# ------------------------------------------------------------------ the signature tree


class SignatureTree:
    """Over sets of tokens. Level 0 are the leaves' members; each node: OR of bitmaps, size range, largest number of collisions.

    rank: sorts the sets before their least tokens do; known components first, so that whole nodes are one component.
    """

    def __init__(self, sets: list[np.ndarray], rank: list[int]) -> None:
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda i: (rank[i], int(sets[i][0]), len(sets[i])))  # similar sets have similar least tokens
        bits = min(1 << 16, max(1024, 1 << int(32 * np.median([len(s) for s in sets]) - 1).bit_length()))
        own = np.zeros((len(sets), bits // 64), np.uint64)
        for row, i in enumerate(self.order):
            at = sets[i] % np.uint64(bits)
            np.bitwise_or.at(own[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        size = np.array([len(sets[i]) for i in self.order])
        extra = size - np.bitwise_count(own).sum(1)
        self.levels = [(own, size, size, extra)]
        while len(self.levels[-1][1]) > 1:
            own, low, high, extra = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            self.levels.append((np.bitwise_or.reduceat(own, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))

    def join(self, percent: int, link, linked) -> None:
        """Calls link(i, j) for pairs that reach the threshold; linked(i, j) tells whether they are one component already."""
        top = len(self.levels) - 1
        self._within(top, 0, percent, link, linked)

    def _members(self, level: int, node: int) -> list[int]:
        width = LEAF**level
        return self.order[node * width : (node + 1) * width]

    def _children(self, level: int, node: int) -> range:
        return range(node * LEAF, min((node + 1) * LEAF, len(self.levels[level - 1][1])))

    def _within(self, level: int, node: int, percent: int, link, linked) -> None:
        if level == 0:
            return
        children = self._children(level, node)
        for c in children:
            self._within(level - 1, c, percent, link, linked)
        self._across(level - 1, [(x, y) for x in children for y in children if x < y], percent, link, linked)

    def _across(self, level: int, pairs: list[tuple[int, int]], percent: int, link, linked) -> None:
        """Dual traversal of pairs of nodes of one level."""
        if not pairs:
            return
        own, low, high, extra = self.levels[level]
        x, y = np.array(pairs).T
        need = percent * np.maximum(low[x], low[y])  # overlap in hundredths that any linked pair has at least
        hold = (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
        most = np.bitwise_count(own[x] & own[y]).sum(1) + np.minimum(extra[x], extra[y])
        most = np.minimum(most, np.minimum(high[x], high[y]))
        hold &= 100 * most >= need
        for i, j in zip(x[hold].tolist(), y[hold].tolist(), strict=True):
            if level == 0:
                a, b = self.order[i], self.order[j]
                if not linked(a, b) and similar(self.sets[a], self.sets[b], percent):
                    link(a, b)
                continue
            first = self.order[i * LEAF**level]
            if all(linked(first, m) for m in self._members(level, i)) and all(linked(first, m) for m in self._members(level, j)):
                continue
            self._across(level - 1, [(p, q) for p in self._children(level, i) for q in self._children(level, j)], percent, link, linked)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Overlaps:
    """Exact overlaps of one set with all others, by numbered tokens."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets])
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        _, self.token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.shared = np.add.reduceat(times[self.token] - 1, self.start) / self.size  # how common a set's tokens are

    def linked(self, i: int, percent: int) -> np.ndarray:
        mark = np.zeros(self.token.max() + 1, bool)
        mark[self.token[self.start[i] : self.start[i] + self.size[i]]] = True
        both = np.add.reduceat(mark[self.token].astype(np.int64), self.start)
        return np.flatnonzero(100 * both >= percent * (self.size + self.size[i] - both))


def _link(rows: pd.DataFrame, n: int, percent: int) -> pd.DataFrame:
    """The links of a block or of two, as a forest over ids. `known`: the component so far, so that known links cost nothing;
    `centre`: sets to compare with all others first."""
    ids = rows["id"].to_numpy()
    find, join = union_find(len(ids))
    seen: dict[int, int] = {}
    for i, c in enumerate(rows["known"].tolist()):
        join(seen.setdefault(c, i), i)
    before = [find(i) for i in range(len(ids))]
    sets = [shingles(t, n) for t in rows["text"]]
    kept = [i for i, s in enumerate(sets) if len(s)]
    if len(set(before)) > 1 and len(kept) > 1:
        own = [sets[i] for i in kept]
        if len(kept) > 2:
            table, centre = Overlaps(own), rows["centre"].to_numpy(bool)[kept]
            given = np.flatnonzero(centre).tolist()
            for turn in range(len(given) + CENTRES):
                if turn < len(given):
                    at = given[turn]
                else:  # the most central set whose component has not been tried
                    free = [k for k in np.argsort(-table.shared, kind="stable")[: 8 * CENTRES].tolist() if find(kept[k]) == kept[k] or turn == len(given)]
                    if turn - len(given) >= len(free):
                        break
                    at = free[turn - len(given)]
                for k in table.linked(at, percent).tolist():
                    join(kept[at], kept[k])
            del table
        tree = SignatureTree(own, [find(i) for i in kept])
        tree.join(percent, lambda a, b: join(kept[a], kept[b]), lambda a, b: find(kept[a]) == find(kept[b]))
    found = [(ids[i], ids[find(i)]) for i in range(len(ids)) if find(i) != i and find(i) != before[i]]
    found += [(ids[before[i]], ids[find(i)]) for i in range(len(ids)) if find(i) != before[i]]
    edges = forest(*np.array(found, np.int64).reshape(-1, 2).T)
    if len(ids) > 200:
        give_back()
    return pd.DataFrame(edges, columns=["a", "b"])


def _nominate(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The most central sets of a block (a random share of its cluster)."""
    sets = [(i, s) for i, t in zip(rows["id"].tolist(), rows["text"], strict=True) if len(s := shingles(t, n))]
    if not sets:
        return pd.DataFrame({"cluster": pd.Series(dtype="i8"), "id": pd.Series(dtype="i8"), "score": pd.Series(dtype="f8")})
    shared = Overlaps([s for _, s in sets]).shared / len(sets)
    best = np.argsort(-shared, kind="stable")[:SHARED_CENTRES]
    return pd.DataFrame({"cluster": rows["cluster"].iloc[0], "id": [sets[k][0] for k in best.tolist()], "score": shared[best]})


# ------------------------------------------------------------------ the operator


def similar_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, n_shingles, component_id of every row. Two rows are linked when 100 * intersection >= percent * union of their shingle sets.

    A-Z is lower-cased, words are runs without [\\x20\\x09-\\x0D]; fewer words than `words` make one shingle of all. Null, empty or
    blank texts have no shingles and are linked with nothing: component_id is their own id. component_id is the smallest id that
    links reach. Ids should be unique: rows that repeat an id count as linked with each other if their sets are equal or similar, and share that
    id's component. A null id gets its n_shingles and a null component. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profiled = cut(source.mapInArrow(partial(_profile, n=words), "id long, n long, s0 long, s1 long, doc boolean"))
    profile = profiled.where("doc").drop("doc")
    shared, shared_path = stored(profiled.where("not doc").groupBy("s0").agg(F.sum("n").alias("n")))
    # the least count of which there are no more than HEAVY_KEPT shingles, by a histogram of counts rather than a sort
    steps = sorted(((r["n"], r["count"]) for r in shared.groupBy(F.least("n", F.lit(HEAVY_STEPS)).alias("n")).count().collect()), reverse=True)
    least, held = HEAVY_STEPS + 1, 0
    for times, many in steps:
        held += many
        if held > HEAVY_KEPT:
            break
        least = times
    common = shared.where(F.col("n") >= least)
    flags = np.zeros(HEAVY_SLOTS, bool)
    flags[(common.select("s0").toPandas()["s0"].to_numpy("i8").view(np.uint64) % np.uint64(HEAVY_SLOTS)).astype(np.int64)] = True
    heavy = spark.sparkContext.broadcast(np.packbits(flags).tobytes())
    remove(spark, shared_path)
    known = profile.where("id is not null and n > 0")
    classes = known.groupBy("n", "s0", "s1").agg(F.min("id").alias("node"))
    member = cut(known.join(classes, ["n", "s0", "s1"]).select("id", "node").distinct())

    total = known.agg(F.sum("n")).first()[0] or 0
    parts = 1 + total // PART_TOKENS
    routed = source.mapInArrow(partial(_route, n=words, percent=percent, heavy_bits=heavy, parts=parts), "part int, first long, keys binary, nodes binary")
    met = routed.repartitionById(parts, "part").mapInArrow(_meet, "a long, b long")
    clusters = components(met).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    # one id a class; clusters of one class are settled
    clusters = clusters.join(member, "id").select(F.col("node").alias("id"), "cluster").distinct()
    extent = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    clusters = cut(clusters.join(extent, "cluster"))
    drop_shuffles(spark)
    lengths = known.select("id", "n").distinct()
    clusters = _told_apart(source, clusters, lengths, words, percent, heavy)

    edges = _join_clusters(source, clusters, lengths, words, percent, block_rows, block_chars)
    # the links are between ids; classes of equal sets are tied by their smallest ids
    own = member.groupBy("id").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    ends = edges.join(own.select(F.col("id").alias("a"), F.col("node").alias("na")), "a").join(own.select(F.col("id").alias("b"), F.col("node").alias("nb")), "b")
    ties = ends.select(F.col("na").alias("a"), F.col("nb").alias("b")).unionByName(own.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    found = components(ties).select("node", "component")
    out = profile.join(own.select(F.col("id").alias("of"), "node").hint("shuffle_hash"), F.col("id") == F.col("of"), "left").drop("of")
    out = out.join(found.hint("shuffle_hash"), "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node", "id").alias("component_id"))


def _told_apart(source: DataFrame, clusters: DataFrame, lengths: DataFrame, words: int, percent: int, heavy) -> DataFrame:
    """clusters (id, cluster) of clusters (id, cluster, rows), the larger ones cut where no pair of sets with a key in common is near enough.
    Sets that are left alone go."""
    large = clusters.where(F.col("rows") > CLOSE_ROWS).select("id")
    total = large.join(lengths, "id").agg(F.sum("n")).first()[0]
    if not total:
        return clusters.select("id", "cluster")
    parts = 1 + total // PART_TOKENS
    schema = "part int, first long, keys binary, nodes binary, ids binary, sizes binary, counts binary"
    routed = sieve(source, large, "id")[0].mapInArrow(partial(_route_counted, n=words, percent=percent, heavy_bits=heavy, parts=parts), schema)
    near = components(routed.repartitionById(parts, "part").mapInArrow(partial(_meet_counted, percent=percent), "a long, b long"))
    near = near.join(large.distinct(), near["node"] == large["id"]).select("id", F.col("component").alias("cluster"))
    told = cut(clusters.where(F.col("rows") <= CLOSE_ROWS).select("id", "cluster").unionByName(near))
    drop_shuffles(source.sparkSession)
    return told


def _pairs_of_blocks(sets: DataFrame, percent: int, block_rows: int, block_chars: int) -> DataFrame:
    """sets (id, cluster, n, chars, ...) with the columns c, d, i, j of each pair of blocks that a set takes part in.

    A block is a size class and a share of its sets by hash. Linked sets lie in one class or in two neighbouring ones (size_classes()).
    """
    bounds = F.array(*(F.lit(b) for b in size_classes(percent, 1 << 40)))
    sets = sets.withColumn("cls", F.size(F.filter(bounds, lambda b: b <= F.col("n"))))
    per = sets.groupBy("cluster", "cls").agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars"))
    parts = F.ceil(F.greatest(F.col("rows") / F.lit(block_rows), F.col("chars") / F.lit(block_chars), F.lit(1.0))).cast("int")
    per = cut(per.select("cluster", "cls", parts.alias("parts")))
    near = lambda step, name: per.select("cluster", (F.col("cls") + step).alias("cls"), F.col("parts").alias(name))
    sets = sets.join(per, ["cluster", "cls"]).join(near(-1, "above"), ["cluster", "cls"], "left").join(near(1, "below"), ["cluster", "cls"], "left")
    own, cls = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.col("cls")
    pair = lambda c, d, i, j: F.struct(c.alias("c"), d.alias("d"), i.alias("i"), j.alias("j"))
    each = lambda m, f: F.when(F.col(m).isNotNull(), F.transform(F.sequence(F.lit(0), F.col(m) - 1), f)).otherwise(F.array())
    pairs = F.concat(
        each("parts", lambda p: pair(cls, cls, F.least(own, p), F.greatest(own, p))),
        each("above", lambda p: pair(cls, cls + 1, own, p)),
        each("below", lambda p: pair(cls - 1, cls, p, own)),
    )
    return sets.withColumn("pair", F.explode(pairs)).select("*", "pair.*").drop("pair", "parts", "above", "below", "cls")


def _join_clusters(source: DataFrame, clusters: DataFrame, lengths: DataFrame, words: int, percent: int, block_rows: int, block_chars: int) -> DataFrame:
    """Links between the members of each cluster (a, b), enough to connect all that are linked."""
    full, _ = sieve(source, clusters, "id")  # texts in no cluster stay where they are
    sizes = full.select("id", F.length("text").alias("chars")).join(clusters, "id").groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars"))
    blocks = F.ceil(F.greatest(F.col("rows") / F.lit(block_rows), F.col("chars") / F.lit(block_chars), F.lit(1.0))).cast("int")
    sizes = cut(sizes.select("cluster", blocks.alias("blocks")))
    large = sizes.where("blocks > 1")
    link = lambda rows, *by: rows.groupBy("cluster", *by).applyInPandas(lambda x: _link(x, words, percent), "a long, b long")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    texts = full.join(clusters.join(sizes, "cluster"), "id").select("id", "text", "cluster", "blocks", F.col("id").alias("known"), F.lit(False).alias("centre")).withColumn("i", block)
    if large.isEmpty():
        return cut(link(texts, "i"))

    # large clusters: the best of the nominated sets go to every block
    named = texts.where("blocks > 1").groupBy("cluster", "i").applyInPandas(lambda x: _nominate(x, words), "cluster long, id long, score double")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("score").desc(), "id"))  # a few rows a block
    centres = cut(named.withColumn("place", place).where(F.col("place") <= SHARED_CENTRES).select("id", "cluster").join(large, "cluster"))
    sent = full.join(centres, "id").select("id", "text", "cluster", "blocks", F.col("id").alias("known"), F.lit(True).alias("centre"))
    sent = sent.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    edges = cut(link(texts.unionByName(sent), "i"))

    label = components(edges)
    state = cut(clusters.join(large, "cluster").join(label, clusters["id"] == label["node"], "left").select("id", "cluster", "blocks", F.coalesce("component", "id").alias("known")))
    open_ = state.groupBy("cluster").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo <> hi").select("cluster")
    rest = state.join(open_, "cluster", "left_semi")
    if rest.isEmpty():
        return edges
    chars = full.groupBy("id").agg(F.sum(F.length("text")).alias("chars"))
    # rows that repeat an id may hold sets of several sizes: all go to the blocks of each size
    open_sets = rest.join(chars, "id").join(lengths, "id").select("id", "cluster", "known", "n", "chars")
    pairs = _pairs_of_blocks(open_sets, percent, block_rows, block_chars).select("id", "cluster", "known", "c", "d", "i", "j").distinct()
    pairs = full.join(pairs, "id").withColumn("centre", F.lit(False))
    return edges.unionByName(cut(link(pairs, "c", "d", "i", "j")))


def drop_similar(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document, that of the smallest id, of each component. Rows of a null id stay."""
    found = similar_components(docs, words, percent, id_col, text_col)
    gone = cut(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct())
    drop_shuffles(docs.sparkSession)
    # documents that surely stay are not moved
    doubtful, sure = sieve(docs, gone, id_col, "_gone")
    return sure.union(doubtful.join(gone, F.col(id_col) == F.col("_gone"), "left_anti"))
