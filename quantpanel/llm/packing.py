"""Best-fit packing by bin completion.

Plan. (1) Documents are tokenised once; each becomes pieces of at most `capacity` ids (only longer documents are cut). The piece
table, a few numbers a piece, is written to the shared folder. (2) Packing needs the lengths only: a histogram of at most
`capacity` counts, whatever the size of the corpus, goes to the driver. Bin completion runs on it: around the largest remaining
length, undominated fillings are enumerated by branch and bound, and each chosen filling is used as often as the counts allow.
(3) The result is a list of segments ("the pieces of this length with ranks lo..hi-1 go to sequences first.., at this offset"), also
bounded by `capacity` alone. Pieces get their rank among equal lengths by a two-level count (no task ranks a whole length), and
join the broadcast segments.
"""

from __future__ import annotations

import logging
import math
import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantpanel.llm.common import cut, text_slices
from quantpanel.llm.tokens import word_encoder
from quantpanel.session import ship_package

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The special token of the vocabulary that the encoder may put between pieces.
MARK = ("<|endoftext|>", 49407)
COMPARED = 48  # items of fillings that are compared for dominance
RANK_ROWS = 100_000  # about so many pieces of one length share a ranking task


# ------------------------------------------------------------------ bin completion on a histogram of lengths


Runs = tuple[tuple[int, int], ...]  # (length, how many of it), lengths falling


def best_fit(lengths: list[int], counts: dict[int, int], room: int) -> Runs:
    """Always the largest item of `lengths` (rising) that fits, as many of it as there are and fit."""
    runs, top = [], len(lengths)
    while (i := min(top, bisect_right(lengths, room)) - 1) >= 0:
        runs.append((lengths[i], min(counts[lengths[i]], room // lengths[i])))
        room -= lengths[i] * runs[-1][1]
        top = i
    return tuple(runs)


def dominates(a: Runs, b: Runs) -> bool:
    """Whether the items of b fit, as into bins, into the items of a: then a leaves smaller items for later and b is not needed. Tried
    first-fit decreasing, for fillings of at most COMPARED items; a True is always right."""
    if max(sum(n for _, n in f) for f in (a or ((0, 0),), b or ((0, 0),))) > COMPARED:
        return False
    bins = [x for x, n in a for _ in range(n)]
    for x, n in b:
        for _ in range(n):
            at = next((i for i, left in enumerate(bins) if left >= x), None)
            if at is None:
                return False
            bins[at] -= x
    return True


def fillings(lengths: list[int], counts: dict[int, int], room: int, nodes: float, most: float = 8, spare: float = math.inf, seen: Counter | None = None) -> list[Runs]:
    """Undominated fillings of `room` with items from `lengths` (rising) as their counts allow, least waste first, larger items first.

    Branch and bound over falling lengths; a node is a length and how many of it to place, so a filling has few nodes however many
    pieces it holds. A node is pruned where even all smaller items leave more room empty than `spare`. The first filling is the
    best-fit one; it is found whatever `nodes` is and is always among those returned, if no other of them dominates it. A filling is
    dominated when an unused item could still be added, or when the items of a kept one could hold all its items; both are
    dropped. `most` fillings are kept. seen counts nodes, pruned and dominated ones, and whether `nodes` ran out.
    """
    greedy = best_fit(lengths, counts, room)
    best = [(room - sum(x * n for x, n in greedy), greedy)]
    budget, seen = nodes, Counter() if seen is None else seen
    all_of = [0, *accumulate(x * counts[x] for x in lengths)]

    def keep(left: int, chosen: Runs) -> None:
        if any(dominates(f, chosen) for _, f in best):
            seen["dominated"] += 1
            return
        best[:] = [(w, f) for w, f in best if not dominates(chosen, f)]
        best.append((left, chosen))
        best.sort(key=lambda f: (f[0], [(-x, -n) for x, n in f[1]]))
        if len(best) > most:
            best.pop()
            seen["dropped"] += 1

    def descend(left: int, top: int, limit: int, chosen: Runs) -> None:
        """limit: the smallest item left out so far."""
        nonlocal budget
        i = min(top, bisect_right(lengths, left)) - 1
        if i < 0:
            if left < limit and left <= spare and chosen != greedy:
                keep(left, chosen)
            return
        while i >= 0:
            if budget <= 0:
                seen["out of nodes"] += 1
                return
            if left - all_of[i + 1] > min(spare, limit - 1):  # too much stays empty, or room for an item left out
                seen["pruned"] += 1
                return
            item = lengths[i]
            for n in range(min(counts[item], left // item), 0, -1):
                if budget <= 0:
                    seen["out of nodes"] += 1
                    return
                budget -= 1
                seen["nodes"] += 1
                low = limit if n == counts[item] else min(limit, item)
                descend(left - n * item, i, low, (*chosen, (item, n)))
            limit = min(limit, item)
            i -= 1

    if best[0][0]:
        descend(room, len(lengths), room + 1, ())
    return [f for _, f in best]


def waste_bound(counts: dict[int, int], capacity: int) -> int:
    """Least number of sequences (the bound L2 of Martello and Toth): for each threshold, items too large to share with those from the
    threshold up, the items over half, and what the others take beyond the room these leave."""
    if not counts:
        return 0
    size = np.array(sorted(counts), np.int64)
    number = np.array([counts[x] for x in size.tolist()], np.int64)
    n, total = (np.concatenate([[0], np.cumsum(x)]) for x in (number, number * size))
    half = int(np.searchsorted(size, capacity // 2, "right"))  # from here on: over half
    big = int(n[-1] - n[half])
    least = np.concatenate([[0], size[:half]])  # thresholds
    lone = np.searchsorted(size, capacity - least, "right")  # from here on: no room for the threshold
    small = total[half] - total[np.searchsorted(size, least)]
    room = (n[lone] - n[half]) * capacity - (total[lone] - total[half])
    return big + max(0, int((-(-(small - room) // capacity)).max()))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Runs, int]]:
    """(filling, times): around the largest length always the largest item that fits. The first incumbent."""
    left, out = dict(counts), []
    while left:
        out.append(_use(left, best_fit(sorted(left), left, capacity)))
    return out


def _use(left: dict[int, int], filling: Runs, most: int | None = None) -> tuple[Runs, int]:
    """Uses the filling as often as the counts allow, `most` times at most."""
    times = min(left[x] // n for x, n in filling)
    times = times if most is None else min(times, most)
    for x, n in filling:
        left[x] -= n * times
        if not left[x]:
            del left[x]
    return filling, times


def bin_completion(counts: dict[int, int], capacity: int, nodes: float = 400, tries: float = 2_000, exact: bool = False, seen: Counter | None = None) -> list[tuple[tuple[int, ...], int]]:
    """(filling, times) that pack all items. Depth-first over fillings around the largest item, best first, with backtracking.

    Best-fit decreasing gives the first incumbent. A branch ends when the sequences used and the waste bound of the rest reach the
    incumbent's number; a filling must not waste more than an improvement could spare. nodes bounds one enumeration, and tries the
    fillings taken after the first dive, so time is bounded; a dive goes on to its end, as there is always a filling and each
    uses up items. exact=True takes neither bound, keeps all undominated fillings and decides sequence by sequence: then the number is
    the smallest there is, in time that may grow exponentially. seen, if given, counts nodes, pruned and dominated fillings, those tried,
    improvements, and where a bound of the search was met ("out of nodes", "dropped", "out of tries"); "bound" is the lower bound, so
    a result of that many sequences is proved to be the best.
    """
    seen = Counter() if seen is None else seen
    if exact:
        nodes = tries = math.inf
    incumbent = best_fit_decreasing(counts, capacity)
    fewest, least = sum(t for _, t in incumbent), waste_bound(counts, capacity)
    seen["bound"], seen["best fit"] = least, fewest
    left, path, used, taken, dived = dict(counts), [], 0, 0, False
    weight = sum(x * n for x, n in left.items())
    stack: list[list[Runs]] = []

    def options() -> list[Runs]:
        lengths = sorted(left)
        top = lengths[-1]
        left[top] -= 1
        rest = lengths if left[top] else lengths[:-1]
        spare = (fewest - 1 - used) * capacity - weight
        found = fillings(rest, left, capacity - top, nodes, math.inf if exact else 8, max(0, spare), seen)
        left[top] += 1
        return [((top, 1 + f[0][1]), *f[1:]) if f and f[0][0] == top else ((top, 1), *f) for f in found][::-1]

    if fewest > least:
        stack.append(options())
    while stack and fewest > least:
        if stack[-1] and (taken < tries or not dived):
            filling, times = _use(left, stack[-1].pop(), 1 if exact else None)
            path.append((filling, times))
            used += times
            weight -= times * sum(x * n for x, n in filling)
            taken += dived
            seen["tried"] += 1
            if not left:
                dived = True
                if used < fewest:
                    incumbent, fewest = list(path), used
                    seen["improved"] += 1
            elif used + waste_bound(left, capacity) < fewest:
                stack.append(options())
                continue
            else:
                dived = True
        else:
            seen["out of tries"] += bool(stack[-1])
            stack.pop()
            if not path:
                break
        filling, times = path.pop()
        used -= times
        weight += times * sum(x * n for x, n in filling)
        for x, n in filling:
            left[x] = left.get(x, 0) + n * times
    return [(tuple(x for x, n in runs for _ in range(n)), times) for runs, times in incumbent]


def segments(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, per sequence, offset): piece of rank r in lo..hi-1 goes to sequence first + (r - lo) // per."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for filling, times in plan:
        at = i = 0
        while i < len(filling):
            n, j = filling[i], i
            while j < len(filling) and filling[j] == n:
                j += 1
            lo = rank.get(n, 0)
            rank[n] = lo + (j - i) * times
            out.append((n, lo, rank[n], sequence, j - i, at))
            at += n * (j - i)
            i = j
        sequence += times
    return out


# ------------------------------------------------------------------ documents to pieces to places


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, end = word_encoder(tokenizer, MARK), struct.pack("<I", end_id)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for part in text_slices(batches):
        ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
        rows = []
        for doc, data in zip(ids, encoder.encode(texts), strict=True):
            data += end
            for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                cut_out = data[at : at + 4 * capacity]
                rows.append((doc, piece, at // 4, len(cut_out) // 4, zlib.crc32(cut_out)))
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a document is its ids and end_id, so it has at least one id."""
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(partial(_pieces, tokenizer=tokenizer, capacity=capacity, end_id=end_id), PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset: gapless from 0 in each sequence, at most `capacity` ids a sequence.

    Null text: empty, so a piece of end_id alone. Repeated rows are packed each; null ids are kept as null. An empty table gives an
    empty result. Other columns are ignored. sequence_id is 0..n-1; which of several equally long pieces stands where is settled by
    a hash of id and piece, then by id and piece, never by chance (rows alike in everything may swap). exact: see bin_completion(); the log
    (INFO) tells the number of sequences, the lower bound and the work of the search.
    """
    spark = docs.sparkSession
    ship_package(spark)
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    seen: Counter = Counter()
    plan = bin_completion(counts, capacity, exact=exact, seen=seen)
    logging.getLogger(__name__).info("%d sequences: %s", sum(times for _, times in plan), dict(seen))
    table = spark.createDataFrame(segments(plan), "length long, lo long, hi long, first long, per long, at long")

    buckets = max(1, -(-max(counts.values(), default=1) // RANK_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("bucket", bucket)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(own) - 1)
    ranked = ranked.join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket")
    # one array of segments a length (bounded by `capacity`), so that a piece meets one row
    lists = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "per", "at"))).alias("segments"))
    placed = ranked.join(F.broadcast(lists), "length").withColumn("s", F.expr("filter(segments, s -> rank >= s.lo and rank < s.hi)[0]"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("s.first") + F.floor((F.col("rank") - F.col("s.lo")) / F.col("s.per"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + (F.col("rank") - F.col("s.lo")) % F.col("s.per") * F.col("length")).cast("long").alias("offset"),
    )
