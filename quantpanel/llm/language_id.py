"""Language ID by language-bitmask n-gram filters.

A model is a bit-sliced Bloom filter: an array of slots, each a bit mask with one bit (slice) a language. Setting a language's bit at
the k slots of an n-gram inserts it into that language's filter; the AND of the k masks of an n-gram gives, in one lookup, all the
languages that contain it. A text is scored by the popcount of each language over its n-grams, corrected for that language's false
positives (fill of its slice to the power k), and the largest corrected share decides.

Training takes a bounded sample of the labelled rows (`per_lang` rows a language, those of the smallest hash of id and language,
over the whole table), whole texts of them: the n-grams that are clearly more frequent in one language than on average, the most telling
first. The n-grams are counted by the executors. The model, SLOTS masks of as many bits as there are languages, goes to the
workers; its size does not depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantpanel.llm.common import forget, give_back, mix64, slices, text_slices
from quantpanel.session import ship_package

#: Parameters of the model: labelled rows a language that it learns from, n-grams a language that its filter holds.
PER_LANG, GRAMS = 400, 20_000
SIZES = (2, 3, 4)  # bytes of an n-gram
SLOTS, K = 1 << 20, 2
WORD_BITS = 64  # languages of one mask word; a model has as many words as it needs
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    masks: np.ndarray  # (words, slots)
    false_rate: np.ndarray  # of each language

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        kept = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not kept or not self.langs:
            return lang, score
        raw = [texts[i].lower().encode("utf-8", "surrogatepass") for i in kept]
        hits, totals = count_masks(raw, self.masks, len(self.langs))
        share = (hits / np.maximum(totals, 1)[:, None] - self.false_rate) / (1 - self.false_rate)
        share = np.clip(share, 0, 1)
        best = share.argmax(1)
        for row, i in enumerate(kept):
            lang[i], score[i] = self.langs[best[row]], float(share[row, best[row]])
        return lang, score


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Every n bytes as one 64-bit number that also tells n."""
    out = np.full(max(0, len(data) - n + 1), n, np.uint64)
    for i in range(n):
        out <<= np.uint64(8)
        out |= data[i : len(data) - n + 1 + i].astype(np.uint64)
    return out


def slots_of(gram: np.ndarray) -> list[np.ndarray]:
    mixed = mix64(gram)
    return [((mixed >> np.uint64(21 * i)) % np.uint64(SLOTS)).astype(np.int64) for i in range(K)]


def _tables(masks: np.ndarray) -> list[np.ndarray]:
    """For n-grams of two bytes the answers of the filter, worked out once; the longer ones look into the slots."""
    a, b = slots_of(np.arange(1 << 16, dtype=np.uint64) | np.uint64(2 << 16))
    return [word[a] & word[b] for word in masks]


def count_masks(raw: list[bytes], masks: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Popcounts of each language over the n-grams of each text, and the number of n-grams. A space stands at both ends of a text."""
    joined = b" " + b" ".join(raw) + b" "
    data = np.frombuffer(joined, np.uint8)
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    hits, totals = np.zeros((len(raw), n_langs)), np.zeros(len(raw))
    pairs = _tables(masks)
    wide = data.astype(np.uint32)
    for n in SIZES:
        if len(data) < n:
            continue
        slots = slots_of(grams(data, n)) if n > 2 else None
        last = max(0, len(data) - n + 1)
        lo = np.minimum(starts[:-1], last)
        hi = np.maximum(lo, np.minimum(starts[1:] + 2 - n, last))  # n-grams that reach from space to space
        for w, word in enumerate(masks):
            found = pairs[w][(wide[:-1] << np.uint32(8)) | wide[1:]] if n == 2 else word[slots[0]] & word[slots[1]]
            for j in range(w * WORD_BITS, min(n_langs, (w + 1) * WORD_BITS)):
                bit = (found >> found.dtype.type(j % WORD_BITS)) & found.dtype.type(1)
                running = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
                hits[:, j] += running[hi] - running[lo]
        totals += hi - lo
    return hits, totals


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of texts with a space at both ends, and how often each occurs."""
    data = [np.frombuffer(b" " + t.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8) for t in texts]
    return np.unique(np.concatenate([grams(d, n) for d in data for n in SIZES] or [np.zeros(0, np.uint64)]), return_counts=True)


def fit(seen: dict[str, tuple[np.ndarray, np.ndarray]], most_grams: int = GRAMS) -> Model:
    """A model of each language's n-grams (sorted) and their counts. No languages: a model that answers und."""
    langs = sorted(seen)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= min(WORD_BITS, max(1, len(langs))))
    masks = np.zeros((max(1, -(-len(langs) // WORD_BITS)), SLOTS), kind)
    if not langs:
        return Model([], masks, np.zeros(0))
    every = np.unique(np.concatenate([g for g, _ in seen.values()]))
    mean = np.zeros(len(every))
    for g, c in seen.values():
        mean[np.searchsorted(every, g)] += c / max(1, c.sum()) / len(langs)
    fill = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        g, c = seen[lang]
        rate, usual = c / max(1, c.sum()), mean[np.searchsorted(every, g)]
        gain = rate * np.log(rate / usual) if len(langs) > 1 else rate  # one language only: every n-gram of it is telling
        chosen = np.argsort(-gain, kind="stable")[:most_grams]
        chosen = chosen[(rate[chosen] > 1.5 * usual[chosen]) | (len(langs) == 1)]
        bit = kind(1 << (i % WORD_BITS))
        word = masks[i // WORD_BITS]
        for at in slots_of(g[chosen]):
            word[at] |= bit
        fill[i] = ((word & bit) != 0).mean()
    return Model(langs, masks, fill**K)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for part in text_slices(batches):
        texts: dict[str, list[str]] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            gram, n = gram_counts(own)
            for i in range(0, len(gram), 50_000):
                some = gram[i : i + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(n[i : i + 50_000].astype("i8"))], ["lang", "gram", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, most_grams: int = GRAMS) -> Model:
    """Fits on `per_lang` labelled rows of each language, whole texts of them. Rows without id, label or text are left out.

    The rows are those of the smallest hash: only ids and labels are ranked, in two steps so that no task ranks a whole language; then
    the n-grams of the chosen rows are counted where the rows are. To the driver go the distinct n-grams of per_lang rows a language.
    Any number of languages; no labelled row gives a model that answers und. Repeated ids may add rows to the sample.
    """
    ship_package(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), lang_col).alias("h"))
    first = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "id")
    second = Window.partitionBy("lang").orderBy("h", "id")
    ids = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_lang)
    ids = ids.withColumn("r", F.row_number().over(second)).where(F.col("r") <= per_lang).select("id", "lang")
    wanted = F.broadcast(ids)  # at most per_lang rows a language
    source = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = source.join(wanted, ["id", "lang"], "left_semi").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = rows.column("lang").to_pandas().to_numpy(), rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    seen = {}
    for name in set(lang.tolist()):
        own = np.flatnonzero(lang == name)
        own = own[np.argsort(gram[own])]
        seen[name] = (gram[own], n[own])
    return fit(seen, most_grams)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1); columns of these names are replaced.

    und with score 0 where the text is null, empty or has no letter, or where the model knows no language. Of equal scores the
    alphabetically first language is taken. Each text is judged whole and by itself; repeated rows get the same answer.
    """
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        for texts in batches:
            langs: list[str] = []
            scores: list[float] = []
            rows = [None if t is None else t for t in texts]
            for i, j in slices([len(t or "") for t in rows], 1_000_000):
                lang, score = held.value.predict(rows[i:j])
                langs += lang
                scores += score
            del rows, texts
            give_back()
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    out = docs.withColumn("__answer", ask(F.col(text_col)))
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return out.select(*rest, F.col("__answer.lang_pred").alias("lang_pred"), F.col("__answer.score").alias("score"))

