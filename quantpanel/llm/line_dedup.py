"""Line dedup: a sharded minimal perfect hash over distinct line hashes indexes fingerprint, count and keeper arrays.

Plan. (1) Every text gives the distinct 128-bit hashes of its line keys; a map-side combined aggregation counts the documents of
each hash and finds the largest id that holds it. (2) Hashes of enough documents are cut into shards by hash; each shard becomes
one row of compact arrays: the levels of a minimal perfect hash, and at its ranks a 64-bit fingerprint, the count and the keeper.
(3) The documents' line hashes are sent to the shards (never the lines) and probe the arrays; a shard whose lines are very common
is repeated under salts, so that no task gets more than about `probe_rows` probes. (4) The hits, a short list a document, come
back to the documents, which drop those lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quantpanel.llm.common import NO_ID, cut, give_back, mix64, text_slices
from quantpanel.session import ship_package

INDEX_SCHEMA = "shard int, sizes binary, bits binary, fingerprint binary, count binary, keeper binary"
GAMMA = 2.0  # slots a key at each level of the minimal perfect hash


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line: stripped of [\\x20\\x09-\\x0D], A-Z lower-cased, UTF-8; None where it has too few code points."""
    keys: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r")
        short = len(key) < min_chars or (len(key) < 4 * min_chars and sum(1 for b in key if b & 0xC0 != 0x80) < min_chars)
        keys.append(None if short else key)
    return keys


def _hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in text_slices(batches, most=4_000_000):
        ids, counts, found = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {digest(k) for k in line_keys(text, min_chars) if k is not None}
            ids.append(NO_ID if doc is None else doc)
            counts.append(len(own))
            found.extend(own)
        words = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        doc = np.repeat(np.array(ids, "i8"), counts)
        for i in range(0, len(doc), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[part])) for x in (words[:, 0], words[:, 1], doc)], ["h0", "h1", "id"])


def _slot(h0: np.ndarray, h1: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h0 + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64) ^ (h1 * np.uint64(2 * level + 1))) % np.uint64(size)).astype(np.int64)


def build_mph(h0: np.ndarray, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level sizes and slots (0/1) of a minimal perfect hash of distinct (h0, h1): a key sits at the first level where it is alone."""
    sizes, levels = [], []
    while len(h0):
        size = max(8, int(GAMMA * len(h0)))
        at = _slot(h0, h1, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        h0, h1 = h0[~alone[at]], h1[~alone[at]]
    return np.array(sizes, "i8"), np.concatenate(levels) if levels else np.zeros(0, bool)


def mph_ranks(h0: np.ndarray, h1: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The rank of each key in 0..n-1, or -1 where no level has its slot. A key that was not indexed may get any rank."""
    before = np.concatenate([[0], np.cumsum(bits)])
    rank, left, start = np.full(len(h0), -1, np.int64), np.arange(len(h0)), 0
    for level, size in enumerate(sizes):
        at = start + _slot(h0[left], h1[left], level, int(size))
        hit = bits[at]
        rank[left[hit]] = before[at[hit]]
        left, start = left[~hit], start + int(size)
    return rank


def _index(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    h0, h1 = rows["h0"].to_numpy().view("u8"), rows["h1"].to_numpy().view("u8")
    sizes, bits = build_mph(h0, h1)
    rank = mph_ranks(h0, h1, sizes, bits)
    arrays = []
    for column in (h1, rows["n"].to_numpy("i8"), rows["keeper"].to_numpy("i8")):
        out = np.empty_like(column)
        out[rank] = column
        arrays.append(out.tobytes())
    return pd.DataFrame([[key[0], sizes.tobytes(), np.packbits(bits).tobytes(), *arrays]], columns=["shard", "sizes", "bits", "fingerprint", "count", "keeper"])


def _probe(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if asked.empty or index.empty:
        return pd.DataFrame({"id": pd.Series(dtype="i8"), "h1": pd.Series(dtype="i8")})
    row = index.iloc[0]
    sizes, fingerprint, keeper = np.frombuffer(row["sizes"], "i8"), np.frombuffer(row["fingerprint"], "u8"), np.frombuffer(row["keeper"], "i8")
    bits = np.unpackbits(np.frombuffer(row["bits"], "u1"), count=int(sizes.sum())).astype(bool)
    h0, h1, doc = (asked[c].to_numpy() for c in ("h0", "h1", "id"))
    rank = mph_ranks(h0.view("u8"), h1.view("u8"), sizes, bits)
    hit = (rank >= 0) & (fingerprint[rank] == h1.view("u8")) & (keeper[rank] != doc)
    return pd.DataFrame({"id": doc[hit], "h1": h1[hit]})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, shard_keys: int = 250_000, probe_rows: int = 500_000) -> DataFrame:
    """docs with the lines gone that at least min_docs documents hold, except in the largest id holding them; adds n_lines, n_dropped.

    A null or empty text is one empty line; its text stays as it is. Lines that stay are joined by \\n, untouched. Each row counts
    as a document, repeated ids too, and every row of the largest id keeps the line. A null id is smaller than any id. An empty
    table gives an empty result. Other columns stay; columns named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashes = source.mapInArrow(partial(_hashes, min_chars=min_chars), "h0 long, h1 long, id long")
    seen = Observation()
    counted = hashes.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
    frequent = cut(counted.observe(seen, F.sum("n").alias("lines"), F.sum(F.expr("int(n >= %d)" % min_docs)).alias("keys")).where(F.col("n") >= min_docs))
    lines, keys = seen.get["lines"] or 0, seen.get["keys"] or 0
    n_shards = max(1, -(-keys // shard_keys), -(-lines // probe_rows))

    shard = F.pmod(F.col("h0"), F.lit(n_shards)).cast("int")
    index = frequent.withColumn("shard", shard).groupBy("shard").applyInPandas(_index, INDEX_SCHEMA)
    # one row a shard: how often its lines are asked for, beyond the even share of rare lines
    salts = frequent.groupBy(shard.alias("shard")).agg(F.ceil(F.sum("n") / F.lit(probe_rows)).cast("int").alias("salts"))
    index = index.join(salts, "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts")
    asked = hashes.withColumn("shard", shard).join(salts.hint("broadcast") if n_shards <= 100_000 else salts, "shard")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("id", "h1"), F.col("salts")).cast("int")).drop("salts")
    gone = asked.groupBy("shard", "salt").cogroup(index.groupBy("shard", "salt")).applyInPandas(_probe, "id long, h1 long")
    gone = gone.groupBy("id").agg(F.collect_set("h1").alias("__gone"))

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def rewrite(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, drop in zip(texts, gone, strict=True):
            lines = (text or "").split("\n")
            if drop is None or not len(drop):
                out.append((text, len(lines), 0))
                continue
            drop = {int(x) for x in drop}
            held = [
                line
                for line, key in zip(lines, line_keys(text, min_chars), strict=True)
                if key is None or int.from_bytes(xxhash.xxh3_128_digest(key)[8:], "little", signed=True) not in drop
            ]
            out.append(("\n".join(held), len(lines), len(lines) - len(held)))
        give_back()
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(*rest, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"))
    joined = keyed.join(gone.hint("shuffle_hash"), keyed["__id"] == gone["id"], "left")
    done = joined.select(*(keyed[c] for c in rest), rewrite(keyed[text_col], F.col("__gone")).alias("__new"))
    return done.select(*(F.col("__new.text").alias(c) if c == text_col else F.col(c) for c in rest), "__new.n_lines", "__new.n_dropped")
