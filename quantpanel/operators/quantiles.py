"""Exact quantiles of a whole column, and of the pooled targets of many sets of leaves, without one task that holds all values."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantpanel.session import ship_package, written

#: So many values of a column are looked at together on the driver.
AT_ONCE = 500_000
#: Ranks around a wanted one that are kept at each pass, as a share of the values left; the sketch errs by half of that at most.
MARGIN = 5e-4
#: Counts (tree, leaf, bucket) that are held together.
COUNTS = 1_000_000


def between(values: np.ndarray, position: float) -> float:
    """Linear, of sorted values, as percentile() has it."""
    low, high = math.floor(position), math.ceil(position)
    a, b = float(values[low]), float(values[high])
    return a if a == b else (high - position) * a + (position - low) * b


def exact_quantiles(rows: DataFrame, column: str, shares: Sequence[float], at_once: int = AT_ONCE) -> list[float] | None:
    """Linear quantiles of the column's values; None without any.

    A sketch brackets each wanted rank; the values in the bracket are counted and bracketed anew until few enough different ones are left to be
    read. The result doesn't depend on the sketch: a bracket that misses its rank is not narrowed.
    """
    values = written(rows.select(F.col(column).cast("double").alias("v")).where("v is not null"))
    n = values.count()
    if not n:
        return None
    if n <= at_once:
        held = np.sort(values.toPandas()["v"].to_numpy())
        return [between(held, (n - 1) * p) for p in shares]
    places = sorted({f((n - 1) * p) for p in shares for f in (math.floor, math.ceil)})
    found: dict[int, float] = {}
    wide: list[tuple[list[int], float | None, float | None, int, int]] = [(places, None, None, 0, n)]  # ranks, values from, to, those before, those inside
    while wide:
        some, low, high, before, inside = wide.pop()
        part = values if low is None else values.where(F.col("v").between(low, high))
        if inside > at_once:
            ends = sorted({min(1.0, max(0.0, (k - before) / inside + s)) for k in some for s in (-MARGIN, MARGIN)})
            edges = sorted(set(part.agg(F.percentile_approx("v", F.array(*map(F.lit, ends)), F.lit(round(2 / MARGIN))).alias("e")).first()["e"]))
            # the edges themselves and what lies between them, each counted
            counted = part.agg(*(F.count(F.when(F.col("v") < e, 1)).alias(f"b{i}") for i, e in enumerate(edges)), *(F.count(F.when(F.col("v") <= e, 1)).alias(f"u{i}") for i, e in enumerate(edges)), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
            below, upto = ([before + counted[f"{s}{i}"] for i in range(len(edges))] for s in "bu")
            gaps: dict[int, list[int]] = {}
            for k in some:
                at = next((i for i in range(len(edges)) if k < upto[i]), len(edges))
                if at < len(edges) and k >= below[at]:
                    found[k] = edges[at]
                else:
                    gaps.setdefault(at, []).append(k)
            for at, ks in gaps.items():
                start, stop = (upto[at - 1] if at else before), (below[at] if at < len(edges) else before + inside)
                # open ends: the next double from the edge
                lo = np.nextafter(edges[at - 1], np.inf) if at else counted["lo"]
                hi = np.nextafter(edges[at], -np.inf) if at < len(edges) else counted["hi"]
                wide.append((ks, float(lo), float(hi), start, stop - start))
            continue
        held = np.sort(part.toPandas()["v"].to_numpy())
        found |= {k: float(held[k - before]) for k in some}
    out = []
    for p in shares:
        position = (n - 1) * p
        low, high = math.floor(position), math.ceil(position)
        out.append(found[low] if found[low] == found[high] else (high - position) * found[low] + (position - low) * found[high])
    return out


# ------------------------------------------------------------------ quantiles of pooled leaves


def _buckets(y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """2 i: between edges i - 1 and i; 2 i + 1: the edge i itself."""
    at = np.searchsorted(edges, y)
    return 2 * at + (edges[np.minimum(at, len(edges) - 1)] == y) * (at < len(edges)) if len(edges) else np.zeros(len(y), np.int64)


def _leaf_matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _matrix(column: pa.ListArray, trees: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, trees)


def pooled_quantiles(leaves: DataFrame, wanted: DataFrame, quantiles: Sequence[float], size: tuple[int, int]) -> DataFrame:
    """leaf, q0, q1, ... for each distinct leaf (an array, a leaf for each tree) of wanted: linear quantiles of the targets y of leaves (leaf, y) that lie in
    these leaves, each as often as trees agree. size: trees, and leaves a tree at most.

    Targets are dealt into buckets by value; counts by tree, leaf and bucket (COUNTS at most, on the driver) tell in which bucket a wanted rank
    lies and its rank there. Then a bucket's targets and the ranks wanted in it meet in one task. Bucket edges are values of their own, so
    that many equal targets need no meeting.
    """
    spark = leaves.sparkSession
    ship_package(spark)
    trees, width = size
    n = leaves.count()
    many = max(1, min(COUNTS // (2 * trees * width), n // 500))
    ends = [i / many for i in range(1, many)]
    edges = np.unique(np.array((leaves.agg(F.percentile_approx("y", F.array(*map(F.lit, ends)), F.lit(10 * many)).alias("e")).first()["e"] if ends else None) or [], float))
    total = 2 * len(edges) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(trees * width * total, np.int64)
        for b in batches:
            if b.num_rows:
                at = (np.arange(trees) * width + _matrix(b.column(0), trees)) * total + _buckets(b.column(1).to_numpy(), edges)[:, None]
                held += np.bincount(at.ravel(), minlength=len(held))
        cell = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(held[cell])], ["cell", "n"])

    cells = leaves.select("leaf", "y").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    upto = np.zeros(trees * width * total, np.int64)
    upto[cells["cell"]] = cells["n"]
    upto = spark.sparkContext.broadcast(upto.reshape(trees, width, total).cumsum(2))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = upto.value
        for b in batches:
            out = []
            for leaf in _leaf_matrix(b["leaf"]) if len(b) else []:
                so_far = c[np.arange(trees), leaf].sum(0)
                place = np.asarray(quantiles) * (so_far[-1] - 1)
                low = np.floor(place).astype(np.int64)
                rank = np.concatenate([low, np.minimum(low + 1, so_far[-1] - 1)])
                at = np.searchsorted(so_far, rank, side="right")
                value = np.where(at % 2 == 1, edges[np.minimum(at // 2, len(edges) - 1)], np.nan) if len(edges) else np.full(len(at), np.nan)
                within = rank - np.where(at > 0, so_far[at - 1], 0)
                out += zip([leaf.tolist()] * len(at), range(len(at)), at.tolist(), within.tolist(), [*(place - low), *(place - low)], value, strict=True)
            made = pd.DataFrame(out, columns=["leaf", "slot", "bucket", "within", "part", "value"])
            yield made

    asked = written(wanted.select("leaf").distinct().mapInPandas(ask, "leaf array<int>, slot int, bucket int, within long, part double, value double"))
    open_ = asked.where("bucket % 2 = 0")
    needed = np.zeros(total, bool)
    needed[[r["bucket"] for r in open_.select("bucket").distinct().collect()]] = True

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _buckets(b.column(1).to_numpy(), edges).astype(np.int32)
            some = pa.array(needed[at])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(some), b.column(1).filter(some), pa.array(at).filter(some)], ["leaf", "y", "bucket"])

    def meet(ranks: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        if not len(ranks):
            return pd.DataFrame({"leaf": [], "slot": [], "part": [], "value": []})
        targets = targets.sort_values("y", kind="stable")
        y, have = targets["y"].to_numpy(), _leaf_matrix(targets["leaf"])
        want, within = _leaf_matrix(ranks["leaf"]), ranks["within"].to_numpy()
        value = np.empty(len(ranks))
        step = max(1, 5_000_000 // len(y))
        for i in range(0, len(ranks), step):
            times = np.zeros((len(want[i : i + step]), len(y)), np.int32)
            for t in range(trees):
                times += want[i : i + step, t, None] == have[:, t]
            value[i : i + step] = y[(times.cumsum(1) <= within[i : i + step, None]).sum(1)]
        return ranks[["leaf", "slot", "part"]].assign(value=value)

    dealt = leaves.select("leaf", "y").mapInArrow(deal, "leaf array<int>, y double, bucket int")
    read = open_.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(meet, "leaf array<int>, slot int, part double, value double")
    every = read.unionByName(asked.where("bucket % 2 = 1").select("leaf", "slot", "part", "value")).groupBy("leaf")
    slot = lambda i, c: F.max(F.when(F.col("slot") == i, F.col(c)))
    k = len(quantiles)
    return every.agg(*((slot(i, "value") + slot(i, "part") * (slot(i + k, "value") - slot(i, "value"))).alias(f"q{i}") for i in range(k)))
