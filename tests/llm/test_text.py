"""Packing, search, sharding, chat, language, SentencePiece and HTML, with edge rows."""

import importlib.util
import itertools
import math
import os
import random
import re
import struct
import time
import uuid
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantpanel.llm import bm25, chat, html_text, language_id, packing, sentencepiece_backend, shards
from quantpanel.llm.common import shared_dir
from quantpanel.llm.tokens import WordEncoder

pytestmark = pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="no vocabularies")
DATA = "/root/testdata/sf0.001"


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return spark.read.parquet(f"{DATA}/documents.parquet")


# ------------------------------------------------------------------ packing

ODD = ["á b", "x\x1cy z", "İstanbul don't", "tab\there  two", "<|endoftext|>x y", "<|startoftext|>", " a b", "ΑΣ ΣΑΣ", "a ́b", "12 3.4!?", "", "\n\n", "Ab, c.", "a!!. b", "don't, x", "<|ENDOFTEXT|> hello", "A<|EndOfText|>B, c.", "<|STARTOFTEXT|>", "Big <|endoftext|> Small", "ª. ß, µ.", "x.\ny,", ". a", "À, É.", "🙂."]


def test_encoder_equals_whole_texts(spark):
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"), packing.MARK)
    texts = ODD + [r.text for r in documents(spark).select("text").collect()]
    for text, e, made in zip(texts, encoder.tokenizer.encode_batch(texts, add_special_tokens=False), encoder.encode(texts), strict=True):
        assert made == struct.pack(f"<{len(e.ids)}I", *e.ids), text[:40]


def test_sentencepiece_full_caches_keep_what_is_in_use(monkeypatch):
    monkeypatch.setattr(sentencepiece_backend, "CACHE_PIECES", 300)
    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece_backend.SpTokenizer(path)
    sp.theirs = theirs = sentencepiece_backend._library(path)
    common = "these words stay in use all the time"
    learned = []
    for i in range(40):
        part = [f"{common} {' '.join(f'x{i}y{k}z%' for k in range(20))}", common, ""]
        fresh = set(sp.known)
        ids = sp.encode(part)
        assert ids == [struct.pack(f"<{len(x)}I", *x) for x in theirs.encode(part)] and sp.decode(ids) == part and all(sp.parity(part, path))
        learned.append(len(set(sp.known) - fresh))
    assert learned[0] == 28 and set(learned[1:]) == {20} and max(len(sp.known), len(sp.spoken)) <= 300


def test_sentencepiece_asks_its_caches_once_for_a_cut():
    """However often it stands in the texts; cuts with one sum are told apart."""

    class Asked(dict):
        n = 0

        def __getitem__(self, key):
            self.n += 1
            return dict.__getitem__(self, key)

        def __contains__(self, key):
            self.n += 1
            return dict.__contains__(self, key)

    path = vocabulary("piece_bpe_32k.model")
    sp, theirs = sentencepiece_backend.SpTokenizer(path), sentencepiece_backend._library(path)
    sp.known, sp.spoken = Asked(), Asked()
    texts = ["again  and again é中🙂 " * 200 + "once", "", "again", "  ", "\0\t\n x" * 50]
    wanted = [struct.pack(f"<{len(x)}I", *x) for x in theirs.encode(texts)]
    assert sp.encode(texts) == wanted and sp.decode(wanted) == texts
    assert sp.known.n < 60 and sp.spoken.n < 60
    sp = sentencepiece_backend.SpTokenizer(path)
    sp.value, bytes_ = np.zeros_like(sp.value), sentencepiece_backend.BYTES.copy()
    try:
        sentencepiece_backend.BYTES[:] = 0  # all sums are equal
        assert sp.encode(texts) == wanted and sp.decode(wanted) == texts
    finally:
        sentencepiece_backend.BYTES[:] = bytes_


def test_encoder_words_with_marks_and_a_full_cache(monkeypatch):
    from quantpanel.llm import tokens

    rng = random.Random(5)
    ends = ["", "%%%", "&&&", ",&&&", "...", ".", "--", "_", "'s", "'", "<|", "|>", "(b)", ")'t", "@x", "##1", "é", "×", "²", "…"]
    texts = [" ".join(rng.choice(["les", "été", "œuf", "Straße", "i'm", "", "don", "9"]) + rng.choice(ends) + rng.choice(ends) for _ in range(40)) for _ in range(300)]
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"), packing.MARK)
    calls, whole = [], WordEncoder._ids
    monkeypatch.setattr(WordEncoder, "_ids", staticmethod(lambda tokenizer, text: calls.append(text) or whole(tokenizer, text)))
    encoder.encode(["les%%% les&&& les été,&&&"])
    assert sorted(encoder.known) == sorted(["", "les", "les%%%", "les&&&", "été", "été,&&&", "%%%", "&&&", ",&&&"])
    assert not any("les" in text and "&" in text for text in calls)  # only the word and the marks were encoded
    monkeypatch.setattr(tokens, "CACHE_PIECES", 300)
    for i in range(0, 300, 20):
        held = set(encoder.known)
        part = texts[i : i + 20]
        for text, e, made in zip(part, encoder.tokenizer.encode_batch(part, add_special_tokens=False), encoder.encode(part), strict=True):
            assert made == struct.pack(f"<{len(e.ids)}I", *e.ids), text[:40]
    assert len(held & set(encoder.known)) > 50  # what is in use stays when the cache is full


def test_pack(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (50, None), (51, "long words here " * 3000), (52, "same"), (52, "same")]
    source = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, piece string")
    made = packing.pack(source, vocabulary("word_bpe_49k.json"), capacity=512).collect()
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"), packing.MARK)
    wanted = []
    for i, t in rows:
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            wanted.append((i, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made), key=key) == sorted(wanted, key=key)
    by = {}
    for r in made:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(source.where("false"), vocabulary("word_bpe_49k.json")).count() == 0


def fewest_bins(items, capacity):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                place(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_instances():
    pick = random.Random(2)
    for _ in range(150):
        items = sorted((pick.randrange(1, 30) for _ in range(pick.randrange(1, 10))), reverse=True)
        counts = {n: items.count(n) for n in items}
        plan = packing.bin_completion(counts, 30)
        used = sorted(itertools.chain.from_iterable(f * t for f, t in plan), reverse=True)
        assert used == items and all(sum(f) <= 30 for f, _ in plan)
        assert sum(t for _, t in plan) == fewest_bins(items, 30)


def test_exact_completion_and_bounds():
    pick, seen = random.Random(3), Counter()
    for _ in range(120):
        items = sorted((pick.randrange(15, 60) for _ in range(pick.randrange(8, 13))), reverse=True)
        counts = dict(Counter(items))
        best = fewest_bins(items, 100)
        assert packing.waste_bound(counts, 100) <= best
        plan = packing.bin_completion(counts, 100, exact=True, seen=seen)
        assert sum(t for _, t in plan) == best
        assert sorted(itertools.chain.from_iterable(f * t for f, t in plan), reverse=True) == items
    assert seen["pruned"] and seen["dominated"] and not seen["out of tries"] and not seen["out of nodes"]
    for _ in range(150):  # larger ones: at least as few as best fit, and often fewer
        counts = dict(Counter(pick.randrange(15, 60) for _ in range(25)))
        one = Counter()
        made = sum(t for _, t in packing.bin_completion(counts, 100, seen=one))
        assert one["bound"] <= made <= one["best fit"]
        seen["better"] += made < one["best fit"]
    assert seen["better"] > 10


def test_waste_bound_by_definition():
    pick = random.Random(4)
    assert packing.waste_bound({}, 10) == 0
    for _ in range(200):
        items = [pick.randrange(1, 41) for _ in range(pick.randrange(1, 30))]
        least = 0
        for p in range(0, 21):
            lone, half, rest = [x for x in items if x > 40 - p], [x for x in items if 20 < x <= 40 - p], [x for x in items if p <= x <= 20]
            least = max(least, len(lone) + len(half) + max(0, -(-(sum(rest) - (40 * len(half) - sum(half))) // 40)))
        assert packing.waste_bound(dict(Counter(items)), 40) == least


def test_completion_beats_best_fit():
    counts = {7: 1, 6: 2, 5: 2, 4: 1, 3: 1, 2: 2}  # 40 in four of ten
    assert sum(t for _, t in packing.bin_completion(counts, 10)) == 4


@pytest.mark.parametrize("short", [{7: 250_000}, {5: 90_000, 7: 90_000, 9: 90_000, 10: 90_000}])
def test_completion_with_masses_of_short_pieces(short):
    pick = random.Random(5)
    for _ in range(5):
        counts = dict(short)
        for _ in range(60):
            counts[pick.randrange(600, 4097)] = pick.randrange(1, 40)
        plan = packing.bin_completion(counts, 4096)
        used = {}
        for filling, times in plan:
            assert sum(filling) <= 4096
            for n in filling:
                used[n] = used.get(n, 0) + times
        assert used == counts
        assert sum(t for _, t in plan) <= packing.waste_bound(counts, 4096) + 1


def test_best_fit_is_among_the_fillings():
    counts = {n: 3 for n in range(3, 40)} | {2: 900}
    for room in range(50, 1000, 50):
        for nodes in (0, 1, 5, 400):
            found = packing.fillings(sorted(counts), counts, room, nodes)
            assert packing.best_fit(sorted(counts), counts, room) in found
            assert all(sum(x * n for x, n in f) <= room and all(n <= counts[x] for x, n in f) for f in found)


def test_segments_cover_every_rank():
    counts = {n: 1 + n * 7 % 13 for n in range(1, 60)}
    plan = packing.bin_completion(counts, 64)
    seen = {n: 0 for n in counts}
    for n, lo, hi, *_ in packing.segments(plan):
        assert lo == seen[n]
        seen[n] = hi
    assert seen == counts


# ------------------------------------------------------------------ search


def brute_search(rows, queries, k):
    terms = {i: bm25.TERM.findall((t or "").lower()) for i, t in rows}
    n, mean = len(rows), sum(map(len, terms.values())) / max(1, len(rows))
    df = {}
    for t in terms.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for q in queries:
        found = []
        for i, t in terms.items():
            score = 0.0
            for w in set(terms[q]):
                tf = t.count(w)
                idf = math.log1p((n - df[w] + 0.5) / (df[w] + 0.5))
                score += terms[q].count(w) * idf * tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * len(t) / mean))
            if score > 0:
                found.append((-round(score, 6), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("shard_terms,block", [(5_000_000, 2_000_000), (300, 40)])
def test_search_equals_brute_force(spark, shard_terms, block):
    pick = random.Random(1)
    words = [f"word{i}" for i in range(80)] + ["the", "of", "Ünï"] * 20
    rows = [(i, " ".join(pick.choices(words, k=pick.randrange(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "only here"), (203, rows[3][1]), (204, rows[3][1]), (205, "the " * 5000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    made = bm25.search(docs, docs.where("doc_id % 7 = 0"), 5, shard_terms=shard_terms, query_terms=block).collect()
    wanted = brute_search(rows, [i for i, _ in rows if i % 7 == 0], 5)
    got = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in made)
    assert [x[:3] for x in got] == [x[:3] for x in sorted(wanted)]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in sorted(wanted)], abs=2e-6)
    assert bm25.search(docs.where("false"), docs.where("false")).count() == 0


def test_search_null_and_repeated_ids(spark):
    rows = [(None, "apple pear"), (1, "apple pear"), (1, "apple plum"), (2, "plum"), (3, None), (4, "fig")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = sorted((r.query_id, r.rank, r.doc_id) for r in bm25.search(docs, docs, 4).collect())
    # null ids are on no side; both rows of id 1 are found; as queries they are one: apple twice, pear, plum
    assert made == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 2), (2, 2, 1), (4, 1, 4)]
    assert bm25.search(docs, docs.where("doc_id is null"), 4).count() == 0


def test_search_skips_blocks():
    """Floors shut blocks, and what is left is what brute force finds."""
    pick = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join(pick.choices(common, k=40) + pick.choices([f"r{i}" for i in range(4000)], k=10)) for _ in range(1500)]
    for i in range(0, 1500, 50):
        texts[i + 7] = texts[i + 9] = texts[i]  # two copies, so the floors of three are high
    every = [bm25.terms_of(t) for t in texts]
    (arrays,) = bm25.build(list(range(1500)), list(every), 10**9)
    shard = bm25.Shard(*arrays, float(np.mean([len(x) for x in every])))
    asked = [np.unique(every[i], return_counts=True) for i in range(0, 1500, 50)]
    df = dict(zip(shard.terms.tolist(), np.diff(shard.start).tolist(), strict=True))
    idf = [np.array([math.log1p((1500 - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()]) for terms, _ in asked]
    weight = np.concatenate([n * w for (_, n), w in zip(asked, idf, strict=True)])
    block = bm25.Queries(np.repeat(np.arange(len(asked)), [len(t) for t, _ in asked]), *(np.concatenate(x) for x in zip(*asked, strict=True)), weight)
    first = {q: (ids, scores) for q, ids, scores in block.search(shard, 3)}
    for q, (ids, scores) in first.items():
        assert ids.tolist() == [q * 50, q * 50 + 7, q * 50 + 9] and len(set(scores)) == 1
    block.raise_floors(np.array(list(first)), np.array([s[-1] for _, s in first.values()]))
    shard.seen = shard.opened = 0
    again = {q: ids.tolist() for q, ids, _ in block.search(shard, 3)}
    assert again == {q: ids.tolist() for q, (ids, _) in first.items()}
    assert 0 < shard.opened < shard.seen / 3


def test_terms_are_those_of_the_pattern(monkeypatch):
    """Many texts are hashed together, Latin-1 and others: equal hashes for equal terms, in each text's order."""
    odd = ["Ünï_cödé ÀÉß µ² ½x", "ΟΔΟΣ Οδοσ ΣΑΣ", "İstanbul istanbul", "a\u0301b e\u0301", "x\u00a0y z\u2019s", "𝐀𝐛 𐐀𐐨 9٣ 中文", "", None, " \n_-", "ab", "ba", "aab aba baa", "\0a\0"]
    pick = random.Random(5)
    texts = odd + [" ".join(pick.choices("Abc abc ABC ÅB åb ñ Ñ x1 1x ω Ω".split(), k=pick.randrange(40))) for _ in range(300)] + ["w" * 700 + " " + "Wort " * 300]
    words = [bm25.TERM.findall((t or "").lower()) for t in texts]
    for together in (200_000, 50):
        monkeypatch.setattr(bm25, "TOGETHER", together)
        made = list(bm25.all_terms(texts))
        assert [len(x) for x in made] == [len(x) for x in words]
        pairs = set(zip(itertools.chain(*words), np.concatenate(made).tolist(), strict=True))
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert [bm25.terms_of(t).tolist() for t in texts] == [x.tolist() for x in made]


def test_terms_take_less_time_than_the_pattern():
    pick = random.Random(6)
    texts = [" ".join("".join(pick.choices("abcdefghijklmnopqrstuvwxyzäé", k=pick.randrange(2, 11))) for _ in range(500)) + ". " for _ in range(300)]
    bm25.terms_of("é ω")  # tables

    def least(work):
        taken = []
        for _ in range(3):
            began = time.process_time()
            work()
            taken.append(time.process_time() - began)
        return min(taken)

    assert least(lambda: list(bm25.all_terms(texts))) < least(lambda: [bm25.TERM.findall(t.lower()) for t in texts])


def test_block_finds_a_shards_terms_once(monkeypatch):
    """Not again for each batch of queries."""
    pick = random.Random(7)
    every = [np.array(pick.sample(range(-2000, 2000), 30), np.int64) for _ in range(400)]
    (arrays,) = bm25.build(list(range(400)), list(every), 10**9)
    shard = bm25.Shard(*arrays, 30.0)
    asked = [np.sort(np.append(x, 5000 + i)) for i, x in enumerate(every)]  # and one that no document has
    block = bm25.Queries(np.repeat(np.arange(400), 31), np.concatenate(asked), np.ones(12400, np.int64), np.ones(12400))
    monkeypatch.setattr(bm25, "BATCH", 20)
    sizes, find = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: sizes.append(np.size(v)) or find(a, v, *rest))
    found = {q: ids.tolist() for q, ids, _ in block.search(shard, 1)}
    monkeypatch.undo()
    assert found == {i: [i] for i in range(400)}
    assert sum(n > 300 for n in sizes) == 1


# ------------------------------------------------------------------ sharding


def test_store(spark):
    store = shards.ShardStore(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", target_bytes=20_000, fanout=3)
    with pytest.raises(ValueError):
        store.read()
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).alias("t"), F.lit(None).cast("int").alias("path")).repartition(6)
    for k in range(5):
        store.append(rows.where(F.col("id") % 5 == k))
    store.append(rows.where("false"))
    before = store.manifest()
    after = store.compact()
    assert after["version"] > before["version"] and len(after["shards"]) < len(before["shards"])
    for version in (before["version"], after["version"]):
        assert store.read(version).exceptAll(rows).count() == 0 and store.read(version).count() == 3000
    assert store.compact() == after  # nothing left to do
    assert store.vacuum() > 0 and store.versions() == [after["version"]] and store.read().count() == 3000
    assert "Python" not in store.read()._jdf.queryExecution().executedPlan().toString()


def test_commit_conflict(spark):
    store = shards.ShardStore(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}")
    base = store.manifest()
    store.append(spark.range(5))
    with pytest.raises(shards.Conflict):
        store._commit(base, [], None, "late")
    assert store.append(spark.range(5, 7))["version"] == 2 and store.read().count() == 7


def test_two_compactors_keep_every_row_once(spark):
    root = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    one, two = (shards.ShardStore(spark, root, fanout=2) for _ in range(2))
    for k in range(4):
        one.append(spark.range(10 * k, 10 * k + 10).coalesce(1))

    class Slow(shards.ShardStore):
        """Between its merge and its commit, `two` compacts everything and appends."""

        def _written(self, folder):
            if not hasattr(self, "once"):
                self.once = two.compact()
                two.append(spark.range(40, 43).coalesce(1))
            return super()._written(folder)

    slow = Slow(spark, root, fanout=2)
    slow.compact()
    assert sorted(r.id for r in one.read().collect()) == list(range(43))
    one.vacuum()
    assert sorted(r.id for r in one.read().collect()) == list(range(43))


def test_writers_side_by_side(spark):
    root = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"

    def work(k):
        store = shards.ShardStore(spark, root, fanout=2)
        for i in range(4):
            store.append(spark.range(100 * k + 10 * i, 100 * k + 10 * i + 10).coalesce(1))
            store.compact()

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(work, range(3)))
    assert sorted(r.id for r in shards.ShardStore(spark, root).read().collect()) == [100 * k + i for k in range(3) for i in range(40)]


def test_one_writer_commits_a_version(spark):
    root = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    stores, start = [shards.ShardStore(spark, root) for _ in range(6)], Barrier(6)

    def work(k):
        won = []
        for version in range(60):
            start.wait(60)
            try:
                stores[k]._commit({"version": version}, [], None, str(k))
                won.append(version)
            except shards.Conflict:
                pass
        return won

    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(work, range(6)))
    assert sorted(sum(won, [])) == list(range(60))
    assert [stores[0].manifest(v + 1)["note"] for v in range(60)] == [str(k) for v in range(60) for k in range(6) if v in won[k]]


def test_arrivals_must_fit(spark):
    store = shards.ShardStore(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}")
    store.append(spark.sql("select 1L as a, 'x' as b"))
    store.append(spark.sql("select 'y' as b, 2L as a"))
    for wrong in ("select 1L as a", "select 1 as a, 'x' as b", "select 1L as a, 'x' as b, 2 as c"):
        with pytest.raises(ValueError):
            store.append(spark.sql(wrong))
    assert sorted((r.a, r.b) for r in store.read().collect()) == [(1, "x"), (2, "y")]


def test_merge_plan():
    class Plan(shards.ShardStore):
        def __init__(self):
            self.target, self.fanout = 1000, 4

    store = Plan()
    made = [{"path": f"p{i}", "bytes": b, "tier": store.tier(b)} for i, b in enumerate([10] * 9 + [300, 310, 900, 1200])]
    runs = store.plan(made)
    assert [sorted(x["bytes"] for x in r) for r in runs] == [[10] * 9]


# ------------------------------------------------------------------ chat

TURNS = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello <|im_end|>"), (1, 3, None, None), (1, 3, "ann", ""), (2, 0, "system", "alone"), (None, 1, "x", "t"), (3, None, "a\nb", "q"), (3, 0, "c", "r"), (3, 0, "c", "r")]


@pytest.mark.parametrize("part_turns", [64, 2])
def test_rotation(spark, part_turns):
    source = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, mask int")
    made = chat.rotate(source, part_turns=part_turns).collect()
    whole = {}
    for r in sorted(made, key=lambda r: r.part):
        spans = [tuple(map(int, s.split("-"))) for s in r.mask.split(",")] if r.mask else []
        said = [r.text[a:b] for a, b in spans]
        assert len(said) == r.text.count("<|im_start|>assistant\n") and r.n_turns <= part_turns
        for a, b in spans:
            assert r.text[:a].endswith("<|im_start|>assistant\n") and r.text[b:].startswith("<|im_end|>\n")
        text, lines = whole.get((r.conv_id, r.speaker), ("", []))
        whole[r.conv_id, r.speaker] = text + r.text, lines + said
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "x"), (3, "a b"), (3, "c")}
    assert whole[1, "ann"][1] == ["Hi", ""] and whole[1, "bob"][1] == ["Hello < |im_end|>"] and whole[3, "c"][1] == ["r", "r"]
    assert whole[1, "bob"][0].startswith("<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>user name=ann\nHi<|im_end|>\n<|im_start|>assistant\n")
    assert chat.rotate(source.where("false")).count() == 0


# ------------------------------------------------------------------ language


def test_language(spark):
    docs = documents(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.train(docs.where(~held))
    made = language_id.identify(docs.where(held), model)
    assert made.where("lang = lang_pred").count() / made.count() > 0.97
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "123 !?", "a"), (4, "the of and " * 20_000, "a"), (5, "a", "a")], "doc_id long, text string, score string")
    rows = language_id.identify(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[3].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows) and len(rows) == 5
    assert language_id.identify(odd.where("false"), model).count() == 0
    none = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}


def test_filter_masks_and_correction():
    rng = np.random.default_rng(0)
    texts = {k: ["".join(rng.choice(list(letters), 6)) for _ in range(3000)] for k, letters in (("p", "abcdef "), ("q", "uvwxyz "), ("r", "abcuvw "))}
    model = language_id.fit({k: language_id.gram_counts([" ".join(v)]) for k, v in texts.items()})
    assert model.predict(["fedcba abc", "zyx wvu", "auav bwcu"])[0] == ["p", "q", "r"]
    hits, totals = language_id.count_masks([b"abc"], model.masks, 3)
    assert totals[0] == 4 + 3 + 2  # two, three and four bytes of " abc "
    alone = [language_id.count_masks([t], model.masks, 3)[0][0] for t in (b"abc", b"uvw xyz")]
    both = language_id.count_masks([b"abc", b"uvw xyz"], model.masks, 3)[0]
    assert np.array_equal(np.stack(alone), both)


def plain_prediction(model, text):
    """Every n-gram by itself, in plain Python."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    data, m64 = b" " + text.lower().encode() + b" ", 2**64 - 1
    hits, total = [0] * len(model.langs), 0
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            x = n
            for byte in data[i : i + n]:
                x = (x << 8 | byte) & m64
            x ^= x >> 33
            x = x * 0xFF51AFD7ED558CCD & m64
            x ^= x >> 33
            x = x * 0xC4CEB9FE1A85EC53 & m64
            x ^= x >> 33
            at = [(x >> (21 * k)) % language_id.SLOTS for k in range(language_id.K)]
            for j in range(len(model.langs)):
                hits[j] += all(int(model.masks[j // 64][a]) >> (j % 64) & 1 for a in at)
            total += 1
    share = [min(1.0, max(0.0, (h / total - f) / (1 - f))) for h, f in zip(hits, model.false_rate.tolist(), strict=True)]
    best = max(range(len(share)), key=lambda j: (share[j], -j))
    return model.langs[best], share[best]


def test_language_equals_brute_force(spark):
    rows = [(1, "The cat sat on the mat and the dog", "en"), (2, "Der Hund und die Katze sind im Haus", "de"), (3, "le chat est dans la maison et il dort", "fr"), (4, "y", None), (5, None, "en"), (None, "the null id", "en"), (6, "Ünï 123", "de"), (7, "", "fr"), (7, "the the the", "en"), (7, "the the the", "en"), (8, "?!", None), (9, "und der " * 4000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, most_grams=60)
    made = language_id.identify(docs.withColumn("lang_pred", F.lit(1)), model).collect()
    assert len(made) == len(rows) and made[0].__fields__ == ["doc_id", "text", "lang", "lang_pred", "score"]
    for r in made:
        if len(r.text or "") < 1000:
            lang, score = plain_prediction(model, r.text)
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-12)


def test_whole_texts_and_many_languages():
    seen = {f"l{i:03d}": language_id.gram_counts([chr(0x3B1 + i % 24) * 2 + chr(0x430 + i // 24) * 3 + " " + chr(0x3B1 + i % 24) + chr(0x430 + i // 24)]) for i in range(150)}
    model = language_id.fit(seen)
    assert model.masks.shape == (3, language_id.SLOTS)
    for i in (0, 63, 64, 100, 128, 149):
        text = chr(0x3B1 + i % 24) * 2 + chr(0x430 + i // 24) * 3
        assert model.predict([text])[0] == [f"l{i:03d}"]
        assert plain_prediction(model, text) == (model.predict([text])[0][0], pytest.approx(model.predict([text])[1][0]))


def test_training_reads_whole_texts(spark):
    docs = spark.createDataFrame([(1, "x " * 5000 + "zebra " * 500, "p"), (2, "x " * 5000 + "lemon " * 500, "q")], "doc_id long, text string, lang string")
    assert language_id.train(docs).predict(["zebra", "lemon"])[0] == ["p", "q"]


# ------------------------------------------------------------------ SentencePiece


def test_sentencepiece_parity(spark):
    odd = ["", "  a  b", " ", "x\ty\nz", "日本語テキスト 😀👍", "<s> </s> <unk> <0x41>", "\x00a", "é́", "   lead", "trail   ", "a b", "ﬁ ½", "a▁b", "▁"]
    texts = odd + [r.text for r in documents(spark).select("text").collect()]
    assert sentencepiece_backend.check_parity(vocabulary("piece_bpe_32k.model"), texts) == []


def test_sentencepiece_unigram(tmp_path):
    """A small unigram model, written by hand in the wire format."""

    def field(number, kind, data):
        return bytes([number << 3 | kind]) + data

    def text(number, data):
        return field(number, 2, bytes([len(data)]) + data)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -1.5, 1), ("a", -2.5, 1), ("▁ab", -4.0, 1)]
    data = b"".join(text(1, text(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += text(2, field(3, 0, b"\1")) + text(3, text(1, b"identity") + field(3, 0, b"\1") + field(4, 0, b"\0"))
    path = tmp_path / "m.model"
    path.write_bytes(data)
    assert sentencepiece_backend.check_parity(str(path), ["ab", "abab", "a b", "aab ba", "abb", "", "azb", "zz a", "a z"]) == []


def test_sentencepiece_tables(spark):
    source = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "Hello  world", 5), (4, "é" * 30_000, 5), (4, "again", 5)], "doc_id long, text string, ids int")
    path = vocabulary("piece_bpe_32k.model")
    made = sentencepiece_backend.round_trip(source, path).collect()
    assert len(made) == 5 and all(r.same for r in made) and made[0].n_ids == 0
    ids = sentencepiece_backend.encode(source, path).collect()
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [list(r.ids) for r in ids] == [theirs.encode(t) for t in ("", "", "Hello  world", "é" * 30_000, "again")]
    assert sentencepiece_backend.round_trip(source.where("false"), path).count() == 0


def test_every_row_is_compared_with_the_library(spark):
    """One row in 256 was, the others were null."""
    path = vocabulary("piece_bpe_32k.model")
    odd = ["", "  a  b", " ", "日本語 😀", "<s> </s> <0x41>", "a▁b", "▁", "trail   ", None]
    source = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert [r.parity for r in sentencepiece_backend.round_trip(source, path).collect()] == [True] * len(odd)

    class Other:
        """A library that knows one word otherwise."""

        def __init__(self, real):
            self.real = real

        def encode(self, text):
            return [1] if "zebra" in text.split(" ") else self.real.encode(text)

        def decode(self, ids):
            return self.real.decode(ids)

    sp = sentencepiece_backend.SpTokenizer(path)
    sp.theirs = Other(sentencepiece_backend._library(path))
    for texts in (["a zebra", "a horse", "zebra "], ["zebras", "the zebra"]):
        sp.encode(texts)
        assert sp.parity(texts, path) == ["zebra" not in t.split() for t in texts]


# ------------------------------------------------------------------ HTML

LONG = "This is the long paragraph that was written for the readers of the paper and it has all of the words that they want to read in it today. " * 2
PAGE = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">Other</a></ul></nav>
<div class="cookie-notice">We use cookies because the law is what it is and you have to accept them all here now please.</div>
<article><header><h1>The  title &amp; more</h1></header><p>{LONG}<p>Short one.<p>{LONG}&nbsp;end<br>line
<div class="ad-box"><p>{LONG}</p></div><aside>{LONG}</aside><form><p>{LONG}</p><input></form>
<section id="comments"><p>{LONG}</p></section><p>Last &lt;b&gt; words.</p></article>
<div id="sidebar"><p>{LONG}</p></div><footer>&copy; {LONG}</footer></body></html>"""


def test_page():
    long = LONG.strip()
    assert html_text.main_text(PAGE) == "\n\n".join(["The title & more", long, "Short one.", f"{long} end line", "Last <b> words."])


def test_page_without_article():
    page = f"<div><a href=1>one</a> <a href=2>two</a></div><div>Intro.</div><div>{LONG}</div><h2>Head</h2><div>{LONG}</div><div>tiny</div><div><a href=3>more links here</a></div>"
    assert html_text.main_text(page) == "\n\n".join(["Intro.", LONG.strip(), "Head", LONG.strip(), "tiny"])


TEXT = "The sea was calm and the wind was from the east, so that all of us went out in the boat and were glad that it was day at last."
PLAIN = [  # (block, whether it is text); no names, no article
    ("<div>" + " ".join(f"<a href={i}>the place that we have been to {i}</a>" for i in range(8)) + "</div>", False),
    (f"<div>Products Imprint Contact Sitemap {'Copyright Terms Careers Press Investors ' * 4}</div>", False),
    ("<h2>A day out</h2>", True),
    (f"<div>{TEXT} {TEXT}</div>", True),
    ("<div>So it went.</div>", True),
    (f"<div>{TEXT} {TEXT}</div>", True),
    ("<div>Login now</div>", False),
    (f"<div>{'Shipping Returns Warranty Newsletter Stores ' * 5}</div>", False),
]


def test_block_rules_decide_without_names():
    page = "".join(b for b, _ in PLAIN)
    wanted = [html_text.SPACE.sub(" ", re.sub("<[^>]*>", "", b)).strip() for b, text in PLAIN if text]
    whole = html_text.main_text(page)
    kept = whole.split("\n\n")
    assert [x for x in kept if x != "Login now"] == wanted  # all text, and of the boilerplate no long block
    for rule in html_text.RULES:  # each rule is needed
        assert html_text.main_text(page, html_text.RULES - {rule}) != whole, rule


def test_names_are_one_sign():
    prose = f"<p>{TEXT} {TEXT}</p>"
    around = html_text.main_text(f'<div class="with-sidebar page">{prose}{prose}</div>')
    assert around == f"{TEXT} {TEXT}\n\n{TEXT} {TEXT}"
    assert html_text.main_text(f'<article>{prose}<div class="related-work">{prose}</div></article>') == around
    assert html_text.main_text(f'<article>{prose}<div class="related"><a href=1>{TEXT}</a></div></article>') == f"{TEXT} {TEXT}"
    assert html_text.main_text(f'<article>{prose}</article><div class="comments">{prose}{prose}</div>') == f"{TEXT} {TEXT}"
    assert html_text.main_text(f'<div>{prose}{prose}</div><div class="cookie-notice">{prose}</div>') == around


def test_short_and_unknown_pages():
    assert html_text.main_text("<p>Rain fell all night.</p><p>Nobody minded.</p>") == "Rain fell all night.\n\nNobody minded."
    chinese = "在一个寒冷的冬天里，小镇上的人们都聚集在广场上，等待着新年的到来，孩子们在雪地里奔跑。" * 4
    assert html_text.main_text(f"<div>{chinese}</div><div>{chinese}</div>") == f"{chinese}\n\n{chinese}"
    pick = random.Random(3)
    words = ["ja", "on", "oli", "että", "se"] + [f"sana{i}" for i in range(300)]
    finnish = [" ".join(pick.choices(words, [60] * 5 + [1] * 300, k=40)) for _ in range(5)]
    menu = " ".join(f"osasto{i}" for i in range(20))
    page = f"<div>{menu}</div>" + "".join(f"<div>{x}</div>" for x in finnish)
    assert html_text.main_text(page) == "\n\n".join(finnish)  # stop words are learned from the page
    figures = f"<article><p>{TEXT}</p><p>{'10 20 30 ' * 12}</p></article>"
    assert html_text.main_text(figures) == f"{TEXT}\n\n{('10 20 30 ' * 12).strip()}"


@pytest.mark.parametrize("unit", ["<a ", "<td>ab</td>", "<div>", "</p>", '<div class="comments">x', '<a "', "<a '", "<", "&", "<script>", "</script ", "<a<a", '"<a "', '<p class="related">a<b>', "<p class", " hidden <p "])
def test_broken_pages_in_linear_time(unit):
    page = "<p><b " + unit * (1_000_000 // len(unit))
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 8


def test_odd_pages(spark):
    pages = [None, "", "   ", "no markup at all", "<", "<p", '<p class="x', "<!-- open", "<script>x", f"<article><p>{LONG}", "</p></div>", "<p>" * 3000, "<a '" * 2000]
    source = spark.createDataFrame([(i, "u", p, "n") for i, p in enumerate(pages)], "page_id long, url string, html string, n_chars string")
    made = html_text.extract(source).orderBy("page_id").collect()
    again = html_text.extract(source.unionByName(source)).groupBy("page_id", "url", "text", "n_chars").count().collect()
    assert len(again) == len(pages) and {r["count"] for r in again} == {2}  # repeated rows stay
    assert [r.text for r in made[:3]] == ["", "", ""] and made[9].text == LONG.strip() and all(r.n_chars == len(r.text) for r in made)
    assert html_text.extract(source.where("false")).count() == 0


def test_pages_of_the_test_data(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    for r in html_text.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect():
        assert r.n_chars == len(r.text) and not re.search(r"</?(?:p|div|nav|b)>", r.text)


def test_pipeline(spark):
    import corpus_pipeline

    documents(spark)
    docs, columns = spark.read.parquet(f"{DATA}/documents.parquet"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "best_fit_packing":
            assert out.columns == columns and out.count() <= docs.count()
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    made = corpus_pipeline.run(spark, DATA)
    assert made.count() == docs.count() and made.select("doc_id", "piece").exceptAll(docs.select("doc_id", "piece")).count() == 0


def line_key(line):
    small = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in small)


def plain_line_dedup(docs):
    holders = {}
    for i, text in docs.items():
        for line in text.split("\n"):
            if len(line_key(line)) >= 20:
                holders.setdefault(line_key(line), set()).add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return {i: "\n".join(x for x in t.split("\n") if common.get(line_key(x), i) == i) for i, t in docs.items()}


def plain_near_copies(docs, n=5, percent=80):
    """The smallest id of each group of linked texts stays."""
    sets = {}
    for i, text in docs.items():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", line_key(text)) if w]
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    group = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for x, y in itertools.combinations(sorted(docs), 2):
            if sets[x] and sets[y] and group[x] != group[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                group[x] = group[y] = min(group[x], group[y])
                changed = True
    return {i: t for i, t in docs.items() if group[i] == i}


def small_corpus():
    pick = random.Random(11)
    english = "the of and to in is that it was for on as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    german = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split()
    rows = []
    for i in range(60):
        words = english if i % 3 else german
        rows.append((i, "\n".join(" ".join(pick.choices(words, k=pick.randrange(8, 30))) for _ in range(pick.randrange(1, 6))), "en" if i % 3 else "de"))
    notice = "All rights reserved, please do not copy this page"
    rows += [(100 + i, rows[i][1] + f"\n  {notice.upper() if i % 2 else notice} ", rows[i][2]) for i in range(12)]  # near copies with a common line
    rows += [(200, None, "en"), (201, "", "en"), (202, "12345 67890 !!!", None), (203, rows[4][1], None), (204, rows[4][1].upper(), None)]
    return rows


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage against plain Python: language by counting n-grams, lines, sets of words, and the tokenizer itself."""
    import corpus_pipeline

    rows = small_corpus()
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.train(docs)
    left = {}
    for i, text, _ in rows:
        lang, score = plain_prediction(model, text)
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            left[i] = text
    assert {200, 201, 202} & set(left) == set() and len(left) > 60
    left = plain_near_copies(plain_line_dedup(left))
    assert len(left) < 65
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"), packing.MARK)
    wanted = []
    for i, text in left.items():
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            wanted.append((i, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made) == sorted(wanted)
    assert len({r.sequence_id for r in made}) == -(-sum(x[3] for x in wanted) // 4096)  # these are few and small


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, n_shingles int, lang_pred int, component_id string"
    base = [(1, "The cat and the dog are on the mat in the house", "en"), (1, "The cat and the dog are on the mat in the house", "en"), (None, "the null id is kept with the others", "en"), (2, None, None), (3, "", "en"), (4, "the word " * 3000, None), (5, "?", "en")]
    odd = spark.createDataFrame([(i, t, lang, None, None, "x", 1, 2, "y") for i, t, lang in base], schema)
    out = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, odd.where("false"), str(tmp_path))
        assert empty.columns == odd.columns and empty.count() == 0
        out = stage(spark, out, str(tmp_path))
        assert out.columns == odd.columns and out.schema["doc_id"].dataType == odd.schema["doc_id"].dataType
    kept = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 1), (False, 4), (True, 0)]
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).collect()
    assert len(pieces) >= 4 and all(r.length <= 4096 for r in pieces)
    assert corpus_pipeline.STAGES[-1][1](spark, odd.where("false"), str(tmp_path)).count() == 0


def test_other_operators_caches_go():
    """A worker that had packed kept its encoder's pieces while it judged languages."""
    import public_tokenizers

    from quantpanel.llm import common, tokens

    mark = ("<|endoftext|>", 1)
    path = public_tokenizers.path("word_bpe_49k.json")
    first = tokens.word_encoder(path, mark)
    assert tokens.word_encoder(path, mark) is first
    common.forget()
    assert tokens.word_encoder(path, mark) is not first
