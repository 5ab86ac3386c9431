"""Exact dedup, line dedup and the n-gram join against brute force, with edge rows."""

import hashlib
import random

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantpanel.llm import exact_dedup, line_dedup, ngram_join
from quantpanel.llm.common import sieve
from quantpanel.llm.components import components

SCHEMA = "doc_id long, text string, h string, n_lines long, extra int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, k) for k, (i, t) in enumerate(rows)], SCHEMA)


EDGES = [(1, None), (2, ""), (3, " "), (4, "Same text"), (5, "same TEXT"), (6, "É"), (7, "é"), (8, "x" * 50_000), (9, "X" * 50_000), (None, "null id"), (None, "Null id"), (12, "\n\n")]


@pytest.mark.parametrize("bits", [128, 4])
def test_exact_groups(spark, bits):
    rows = [r for r in EDGES if r[0] is not None] + [(100 + i, random.Random(i % 40).choice("ab") * (i % 7)) for i in range(200)]
    low = {i: "".join(c.lower() if c.isascii() else c for c in t or "") for i, t in rows}
    made = {r.doc_id: r for r in exact_dedup.exact_groups(table(spark, rows), keep="max", hash_bits=bits).collect()}
    assert len(made) == len(rows)
    for i, t in low.items():
        group = [j for j, u in low.items() if u == t]
        r = made[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(group), len(group), i == max(group), hashlib.sha256(t.encode()).hexdigest())


def test_exact_null_ids_repeats_and_empty(spark):
    made = exact_dedup.exact_groups(table(spark, EDGES + [(4, "Same text")])).collect()
    assert all(r.kept and r.keep_id is None and r.group_size == 2 for r in made if r.doc_id is None)
    assert sorted((r.kept, r.group_size) for r in made if r.doc_id in (4, 5)) == [(False, 3), (True, 3), (True, 3)]
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0
    assert {r.doc_id for r in exact_dedup.drop_exact_copies(table(spark, EDGES)).collect()} == {1, 3, 4, 6, 7, 8, 12, None}


def test_exact_plan_is_native(spark):
    plan = exact_dedup.exact_groups(table(spark, EDGES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_lines(rows, least=20, docs=3):
    holds = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= least:
                holds.setdefault(key, set()).add(i)
    out = {}
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            key = "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if not (len(holds.get(key, ())) >= docs and max(holds[key]) != i):
                kept.append(line)
        out[i] = ("\n".join(kept), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept))
    return out


@pytest.mark.parametrize("shard_keys,probe_rows", [(250_000, 500_000), (2, 5)])
def test_lines(spark, shard_keys, probe_rows):
    pick = random.Random(5)
    lines = [f"A common line number {k} of the corpus" for k in range(12)] + ["short", "", "ééééééééééééééééééé", "éééééééééééééééééééé", "  A COMMON line number 3 of the corpus\t"]
    rows = [(i, "\n".join(pick.choices(lines, k=pick.randrange(1, 9)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n"), (103, " padded with an odd space, long enough")]
    made = line_dedup.dedup_lines(table(spark, rows), shard_keys=shard_keys, probe_rows=probe_rows).collect()
    wanted = brute_lines(rows)
    assert len(made) == len(rows)
    assert {r.doc_id: (r.text or "", r.n_lines, r.n_dropped) for r in made} == wanted
    assert all(r.extra is not None and r.h == "x" for r in made)


def test_lines_empty_and_null_ids(spark):
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    line = "a line that is long enough to count"
    made = line_dedup.dedup_lines(table(spark, [(None, line), (None, line), (1, line)])).collect()
    assert sorted((r.doc_id is None, r.n_dropped) for r in made) == [(False, 0), (True, 1), (True, 1)]


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    h0, h1 = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    h0[:50] = h0[50]  # equal first words
    sizes, bits = line_dedup.build_mph(h0, h1)
    assert sorted(line_dedup.mph_ranks(h0, h1, sizes, bits)) == list(range(5000))
    assert len(bits) < 5 * 5000


def plain_shingles(text, n):
    """Sets of tuples of words, from the definition."""
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", small) if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_components(rows, n, percent):
    sets = {i: plain_shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and len(sets[x]) and len(sets[y]) and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=12, most=14):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(groups):
        words = [f"w{v}" for v in rng.integers(0, 4000, rng.integers(3, 160))]
        for _ in range(rng.integers(1, most)):
            own = list(words)
            for _ in range(rng.integers(0, max(2, len(words) // 30))):
                own[rng.integers(len(own))] = f"z{rng.integers(10**6)}"
            rows.append((i, " ".join(own)))
            i += 1
            if rng.random() < 0.5:
                words = own  # chains of copies
    return rows


@pytest.mark.parametrize("n,percent,block", [(4, 85, 4000), (5, 80, 3)])
def test_ngram_components(spark, n, percent, block):
    rows = near_copies(n) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "Two words"), (1004, "two WORDS"), (1005, "y " * 3000), (1006, "y " * 9)]
    made = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(table(spark, rows), n, percent, block_rows=block).collect()}
    assert made == brute_components(rows, n, percent)


def test_large_clusters_over_many_blocks(spark):
    """Chains of copies and sets of many sizes in one cluster, in blocks of two sets."""
    rng = np.random.default_rng(9)
    rows, words = [], [f"w{v}" for v in rng.integers(0, 4000, 120)]
    for i in range(70):
        words = list(words)
        for _ in range(2):
            words[rng.integers(len(words))] = f"z{i}.{rng.integers(10**6)}"
        rows.append((i, " ".join(words if i % 3 else words[: len(words) * 9 // 10])))
    made = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(table(spark, rows), 5, 80, block_rows=2).collect()}
    assert made == brute_components(rows, 5, 80)


def test_unlike_texts_that_share_passages_are_not_gathered(spark, monkeypatch):
    """Keys of a passage that two unlike texts have in common tied 300 texts into one cluster, whose texts all moved."""
    rng = np.random.default_rng(3)
    pool = [" ".join(f"p{p}.{w}" for w in range(5)) for p in range(100)]
    rows = [(i, " ".join(pool[p] for p in rng.choice(100, 8, replace=False))) for i in range(300)]
    rows += [(400 + i, rows[i][1] + " tail") for i in range(0, 60, 3)] + [(7, rows[7][1] + " tail"), (7, "nothing like it"), (500, "nothing like it at all")]
    gathered, inner = [], ngram_join._join_clusters

    def spy(source, clusters, *rest):
        gathered.extend(r["count"] for r in clusters.groupBy("cluster").count().collect())
        return inner(source, clusters, *rest)

    monkeypatch.setattr(ngram_join, "_join_clusters", spy)
    monkeypatch.setattr(ngram_join, "CLOSE_ROWS", 1)
    made = {r.doc_id: r.component_id for r in ngram_join.similar_components(table(spark, rows), 5, 80).collect()}
    assert sum(gathered) < 80 and max(gathered) < 10
    whole = {i: c for i, (_, c) in brute_components([r for r in rows if r[0] != 7 or r is rows[7]], 5, 80).items()}
    assert made == whole


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_counts_lose_no_link(percent):
    rng = np.random.default_rng(percent)
    sets, pairs = [], []
    for n in (1, 5, 30, 95, 97, 400, 5000):
        base = np.unique(rng.integers(0, 2**64, n, np.uint64))
        for keep in (1.0, 0.95, 0.9, percent / 100, 0.3):
            more = rng.integers(0, 2**64, rng.integers(0, 2 + n // 6), np.uint64)
            sets.append(np.unique(np.append(base[rng.random(len(base)) < keep], more)))
    pairs = np.array([(i, j) for i in range(len(sets)) for j in range(len(sets)) if i < j])
    made = ngram_join.Counted(np.array([len(s) for s in sets]), [ngram_join.counts(s) for s in sets]).near(*pairs.T, percent)
    linked = np.array([len(sets[i]) > 0 and len(sets[j]) > 0 and ngram_join.similar(sets[i], sets[j], percent) for i, j in pairs])
    assert linked.any() and made[linked].all() and not made.all()


def test_shingles_by_definition():
    text = "One two\tTHREE four five six"
    words = text.lower().split()  # the no-break space is no separator here
    words = ["one", "two", "three", "four five", "six"]
    assert len(ngram_join.shingles(text, 4)) == len({tuple(words[i : i + 4]) for i in range(2)})
    assert len(ngram_join.shingles("a a a a a a", 4)) == 1 and len(ngram_join.shingles("a b", 4)) == 1 and len(ngram_join.shingles(None, 4)) == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_key(percent):
    """Routing is exact: random pairs just at the threshold, with any flags of common shingles."""
    rng = np.random.default_rng(percent)
    heavy = rng.random(ngram_join.HEAVY_SLOTS) < 0.4
    for _ in range(300):
        n = int(rng.integers(5, 400))
        both = rng.integers(0, 2**64, n, dtype=np.uint64)
        spare = int(n * (100 / percent - 1))
        left = int(rng.integers(0, spare + 1))
        other = rng.integers(0, 2**64, spare, dtype=np.uint64)
        a, b = np.unique(np.concatenate([both, other[:left]])), np.unique(np.concatenate([both, other[left:]]))
        if len(a) == len(b) == n or not ngram_join.similar(a, b, percent):
            continue
        for flags in (None, heavy):
            assert np.intersect1d(ngram_join.keys_of(a, percent, flags), ngram_join.keys_of(b, percent, flags)).size


def test_tree_prunes_and_finds_all():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64)) for _ in range(200)]
    sets += [np.unique(np.append(s[: len(s) - 2], rng.integers(0, 2**64, 2, dtype=np.uint64))) for s in sets[:50]]
    found = set()
    ngram_join.SignatureTree(sets, [0] * len(sets)).join(80, lambda a, b: found.add((min(a, b), max(a, b))), lambda a, b: False)
    assert found == {(a, b) for a in range(250) for b in range(a + 1, 250) if ngram_join.similar(sets[a], sets[b], 80)}


def test_ngram_null_ids_repeats_empty(spark):
    assert ngram_join.similar_components(table(spark, [])).count() == 0
    made = ngram_join.similar_components(table(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in made) == [(0, 0), (3, 3), (3, 3), (5, 3)]
    rest = ngram_join.drop_similar(table(spark, [(None, "a"), (5, "a b c d e f"), (3, "A b c d e f")]))
    assert sorted(r.doc_id or 0 for r in rest.collect()) == [0, 3]


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select((F.col("id") * 7 % 201).alias("a"), ((F.col("id") + 1) * 7 % 201).alias("b"))
    made = components(edges.union(spark.createDataFrame([(1000, 1000), (2001, 2000)], "a long, b long"))).collect()
    assert {r.component for r in made} == {0, 2000} and len({r.node for r in made}) == len(made) == 203


def test_routing_keys_are_packed_whole():
    rng = np.random.default_rng(3)
    for rows, parts, ids in ((200_000, 7, np.arange(5_000)), (1, 3, np.array([-5])), (0, 2, np.arange(2)), (300, 1, np.array([-(2**63), 2**63 - 1, 0]))):
        key, node = rng.integers(0, 2**64, rows, np.uint64), rng.choice(ids, rows)
        sent = ngram_join.packed(key, node, parts)
        got = ngram_join.unpacked(sent)
        whole = sorted(zip((key >> np.uint64(64 - ngram_join.KEY_BITS)).tolist(), node.tolist(), strict=True))
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == whole
        assert sent.column("part").to_pylist() == sorted(set(((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).tolist()))
    sent = ngram_join.packed(rng.integers(0, 2**64, 200_000, np.uint64), rng.choice(5_000, 200_000), 7)
    assert sum(len(x) for c in ("keys", "nodes") for x in sent.column(c).to_pylist()) < 8 * 200_000  # two numbers of 8 bytes each before


def test_texts_that_stay_are_not_exchanged(spark):
    """Neither those of no cluster, before the join, nor those that are kept, after it, however many go."""
    rows = table(spark, [(i, f"a b c d e f {i // 2 if i % 10 < 2 else -i}") for i in range(400)] + [(None, "a b c d e f 0"), (0, "twice")])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gone = spark.range(40, 80).selectExpr("id as _gone")
        doubtful, sure = sieve(rows, gone, "doc_id", "_gone")
        assert "Exchange hashpartitioning" not in sure._jdf.queryExecution().toString()
        left, out = [r.doc_id for r in sure.collect()], [r.doc_id for r in doubtful.collect()]
        assert set(range(40, 80)) <= set(out) and None in left and len(out) < 60 and len(left) + len(out) == 402
        made = ngram_join.drop_similar(rows, words=20, percent=80)
        assert re.search(r"Union\n *:- BroadcastHashJoin", made._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    firsts = {}
    kept = [i for i, t in [(i, f"{i // 2 if i % 10 < 2 else -i}") for i in range(400)] if firsts.setdefault(t, i) == i]
    assert sorted(r.doc_id for r in made.collect() if r.doc_id is not None) == sorted([*kept, 0])
    assert made.columns == rows.columns and made.where("doc_id is null").count() == 1
