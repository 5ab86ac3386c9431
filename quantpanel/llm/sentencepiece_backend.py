"""SentencePiece encoding and decoding with the `tokenizers` library as backend.

The model's protobuf is parsed here (wire format, only the fields needed); its normaliser, white-space marker, scores and byte
fallback are rebuilt as a tokenizers pipeline: a Unigram model with the scores, or a BPE model whose merges follow from the
scores. Texts are encoded and decoded by the tokenizers library alone. round_trip() compares every row with the
sentencepiece library, by its distinct cuts.

No piece of such a model has the white-space marker behind another character, so text is cut before each run of spaces and ids before
each piece that begins with the marker; distinct cuts, told by array operations, are encoded and decoded once, in multithreaded batches,
and kept in bounded caches.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, partial
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from quantpanel.llm.common import mix64, text_slices
from quantpanel.session import ship_package

MARKER = "▁"
NORMAL, UNKNOWN_TYPE, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_PIECES = 800_000
TOGETHER = 1_000  # cuts that share a call of the library
PARITY_EACH = 256  # one row of so many, by the checksum of its ids, is compared whole with the sentencepiece library, besides its cuts
CUT = re.compile(r" +[^ ]*|[^ ]+")
BYTES = mix64(np.arange(1, 257))
BYTE_PIECE = re.compile(r"<0x[0-9A-F]{2}>")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; groups are not supported."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class SpModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True


def parse_model(data: bytes) -> SpModel:
    out = SpModel()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            out.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            out.kind, out.byte_fallback, out.unk_id = spec.get(3, 1), bool(spec.get(35, 0)), spec.get(40, 0)
        elif number == 3:
            spec = dict(_fields(value))
            out.charsmap, out.dummy_prefix, out.squeeze_spaces = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    return out


def merges_of(model: SpModel) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, best score of the made piece first, then by the parts' ids."""
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = []
    for piece, score, kind in model.pieces:
        if kind in (NORMAL, USER) and len(piece) > 1:
            ways = [(ids[piece[:i]], ids[piece[i:]], piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in ids and piece[i:] in ids]
            found += [(-score, *way) for way in ways]
    return [(a, b) for *_, a, b in sorted(found)]


def _stretches(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], and so on."""
    out = np.repeat(start - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


class Cuts:
    """Rows of units (bytes of text, or ids) in cuts; equal cuts are of one kind. mark: the units that begin a cut, besides those that begin
    a row; value: a random number of each unit."""

    def __init__(self, units: np.ndarray, sizes: list[int], mark: np.ndarray, value: np.ndarray) -> None:
        stop = np.cumsum([0, *sizes])
        mark[stop[:-1][np.diff(stop) > 0]] = True
        start = np.flatnonzero(mark)
        n = np.diff(np.append(start, len(units)))
        self.rows = np.searchsorted(start, stop)  # each row's first cut
        # a sum over the units of their number times that of their place, so that equal cuts stand together
        place = np.arange(len(units))
        place -= np.repeat(start, n)
        parts = value[units]
        parts *= (mix64(np.arange(1, n.max(initial=0) + 1) << 32) | np.uint64(1))[place]
        sums = np.add.reduceat(parts, start) if len(start) else parts
        del place, parts
        order = np.argsort(sums)
        head = np.append(True, np.diff(sums[order]) != 0)[: len(order)]
        first, self.kind = order[head], np.empty(len(order), np.intp)
        self.kind[order] = np.cumsum(head) - 1
        if not np.array_equal(n[first][self.kind], n) or not np.array_equal(units[_stretches(start[first][self.kind], n)], units):
            first = self.kind = np.arange(len(start))  # two cuts with one sum: each is of its own kind
        width, data = units.itemsize, units.tobytes()
        self.each = [data[a:b] for a, b in zip((start[first] * width).tolist(), ((start + n)[first] * width).tolist(), strict=True)]

    def put(self, each: list[bytes], lost: int = 0) -> list[bytes]:
        """The rows with other bytes for each kind, without the first ones of a row."""
        n = np.array([len(x) for x in each], np.int64)
        long = n[self.kind]
        data = np.frombuffer(b"".join(each), "u1")[_stretches((np.cumsum(n) - n)[self.kind], long)].tobytes()
        stop = np.append(0, np.cumsum(long))[self.rows].tolist()
        return [data[a + lost : b] for a, b in zip(stop[:-1], stop[1:], strict=True)]


def _news(cuts: list, known: dict) -> tuple[list, dict]:
    """The cuts that are not known yet, and the cache; where it is full, without the cuts that are not at hand."""
    new = list(dict.fromkeys(filterfalse(known.__contains__, cuts)))
    if len(known) + len(new) > CACHE_PIECES:
        known = {c: known[c] for c in cuts if c in known}
    return new, known


class SpTokenizer:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = self.model = parse_model(f.read())
        if model.kind == 2:
            vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
            inner = models.BPE(vocabulary, merges_of(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
        elif model.kind == 1:
            inner = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models")
        self.tokenizer = Tokenizer(inner)
        self.tokenizer.add_tokens([AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER])
        self.prepare = normalizers.Sequence(
            ([normalizers.Precompiled(model.charsmap)] if model.charsmap else [])
            + ([normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()] if model.squeeze_spaces else [])
        )
        self.tokenizer.normalizer = normalizers.Replace(" ", MARKER)
        unknown = decoders.Replace(model.pieces[model.unk_id][0], " \u2047 ")  # a whole piece; text never holds it as one
        self.tokenizer.decoder = decoders.Sequence([unknown, decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
        self.plain = not model.charsmap and not model.squeeze_spaces
        # pieces with the marker behind another character, or that hold several words, would forbid cutting before spaces
        self.cuts = not any(re.search(rf"[^{MARKER}]{MARKER}", p) for p, _, _ in model.pieces)
        self.known: dict[bytes, bytes] = {}  # ids of a cut's text in UTF-8
        self.spoken: dict[bytes, bytes] = {}  # the text of ids, behind the space that a cut begins with
        self.begins = np.array([p.startswith(MARKER) for p, _, _ in model.pieces])
        self.value = mix64(np.arange(1, len(model.pieces) + 1))
        self.silent = np.array([kind == CONTROL for _, _, kind in model.pieces])
        self.theirs = None  # the sentencepiece library, where cuts are to be compared with it
        self.unlike: set[str] = set()  # cuts that it encodes or decodes otherwise

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not self.plain:
            texts = [self.prepare.normalize_str(t) for t in texts]
        # the marker itself counts as a space
        texts = [(" " + t if t and self.model.dummy_prefix else t).replace(MARKER, " ") for t in texts]
        data = [t.encode() for t in texts]
        units = np.frombuffer(b"".join(data), "u1")
        mark = units == 32
        mark[1:] &= units[:-1] != 32
        split = Cuts(units, list(map(len, data)), mark if self.cuts else np.zeros(len(units), bool), BYTES)
        new, self.known = _news(split.each, self.known)
        fresh = new
        # cuts of one space, at their head, share a call: their ids begin where a piece begins with the marker
        plain = [c for c in new if c[:1] == b" " and c.find(b" ", 1) < 0] if self.cuts else []
        chunks = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for part, e in zip(chunks, self.tokenizer.encode_batch_fast([b"".join(c).decode() for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            edge = (4 * np.flatnonzero(self.begins[ids])).tolist()
            if len(edge) == len(part) and not edge[0]:
                data = ids.tobytes()
                self.known.update(zip(part, [data[a:b] for a, b in zip(edge, [*edge[1:], len(data)], strict=True)], strict=True))
        new = [c for c in new if c not in self.known]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False), strict=True):
                ids = e.ids
                self.known[piece] = struct.pack(f"<{len(ids)}I", *ids)
        out = split.put(list(map(self.known.__getitem__, split.each)))
        if self.theirs is not None:
            self._compare(fresh)
        return out

    def _compare(self, cuts: list[bytes]) -> None:
        """New cuts against the library, which puts a space before a text itself: many as one text, and each where that text differs."""
        step = TOGETHER if len(cuts) > 1 else 1
        for i in range(0, len(cuts), step):
            part = cuts[i : i + step]
            ids = self.theirs.encode(b"".join(part)[1:].decode())
            data = b"".join(map(self.known.__getitem__, part))
            if np.array(ids, "<u4").tobytes() == data and self.theirs.decode(ids) == self.decode([data])[0]:
                continue
            if len(part) == 1:
                self.unlike.add(part[0].decode())
            else:
                for cut in part:
                    self._compare([cut])

    def parity(self, texts: list[str], path: str) -> list[bool]:
        """Of encoded texts, whether the library gives the same ids and text. No piece reaches over a cut, so a text is alike where its cuts
        are; where texts can't be cut, each is compared whole."""
        if self.theirs is None:
            wrong = set(check_parity(path, texts))
            return [t not in wrong for t in texts]
        if not self.unlike:
            return [True] * len(texts)
        return [self.unlike.isdisjoint(CUT.findall((" " + t if t else t).replace(MARKER, " "))) for t in texts]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of encode()'s bytes. Ids of control pieces give nothing; bytes that are no UTF-8 give U+FFFD each."""
        rows = [np.frombuffer(x, "<u4") for x in ids]
        rows = [row[~self.silent[row]] if self.silent[row].any() else row for row in rows]
        if not (self.cuts and self.model.dummy_prefix):
            return self.tokenizer.decode_batch([row.tolist() for row in rows], skip_special_tokens=False)
        units = np.concatenate([np.zeros(0, "<u4"), *rows])
        split = Cuts(units, list(map(len, rows)), self.begins[units], self.value)
        new, self.spoken = _news(split.each, self.spoken)
        # cuts that begin with the marker share a call too: each gives one space and what follows it
        plain = [c for c in new if self.begins[int.from_bytes(c[:4], "little")]]
        chunks = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for part, text in zip(chunks, self.tokenizer.decode_batch([np.frombuffer(b"".join(c), "<u4").tolist() for c in chunks], skip_special_tokens=False), strict=True):
            words = text.encode().split(b" ")
            if len(words) == len(part):
                self.spoken.update(zip(part, [b" " + w for w in words], strict=True))
        new = [c for c in new if c not in self.spoken]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            said = self.tokenizer.decode_batch([np.frombuffer(c, "<u4").tolist() for c in part], skip_special_tokens=False)
            self.spoken.update(zip(part, [b" " + text.encode() for text in said], strict=True))
        return [row.decode() for row in split.put(list(map(self.spoken.__getitem__, split.each)), 1)]


@cache
def sp_tokenizer(path: str) -> SpTokenizer:
    """One a Python worker. The library takes as many threads as an executor has cores, where Spark tells them; more would only spin."""
    if cores := os.environ.get("OMP_NUM_THREADS"):
        os.environ.setdefault("RAYON_NUM_THREADS", cores)
    return SpTokenizer(path)


@cache
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_parity(path: str, texts: list[str]) -> list[str]:
    """Those of the texts that the sentencepiece library encodes or decodes otherwise."""
    theirs, ours = _library(path), sp_tokenizer(path)
    wrong = []
    for text, mine in zip(texts, ours.encode(texts), strict=True):
        ids = theirs.encode(text)
        if struct.pack(f"<{len(ids)}I", *ids) != mine or theirs.decode(ids) != ours.decode([mine])[0]:
            wrong.append(text)
    return wrong


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    sp = sp_tokenizer(path)
    for part in text_slices(batches):
        ids = sp.encode([t or "" for t in part.column(1).to_pylist()])
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("i4")
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "ids"])


def _round(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    sp = sp_tokenizer(path)
    if sp.theirs is None and sp.cuts and sp.plain and sp.model.dummy_prefix:
        sp.theirs = _library(path)
        sp.known.clear()  # what is known has not been compared
    for part in text_slices(batches):
        texts = [t or "" for t in part.column(1).to_pylist()]
        ids = sp.encode(texts)
        back = [a == b for a, b in zip(texts, sp.decode(ids), strict=True)]
        sums = list(map(zlib.crc32, ids))
        # a sample is compared whole besides
        parity = [same and (c % PARITY_EACH > 0 or not check_parity(path, [t])) for same, t, c in zip(sp.parity(texts, path), texts, sums, strict=True)]
        columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sums, pa.int64()), pa.array(back), pa.array(parity, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_ids", "ids_crc32", "same", "parity"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int). Null text: no ids. Every row is encoded whole, repeated rows and null ids too."""
    ship_package(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(partial(_encode, path=path), "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_ids, ids_crc32 (of little-endian 32-bit ids), same: whether decoding the ids gives the text again (null: as empty), parity:
    whether the sentencepiece library gives the same ids and text, of every row: each distinct cut is compared, and one row in PARITY_EACH
    (chosen by ids_crc32) whole.

    same is false where the model's normaliser changes a text, or where the text holds the marker character itself.
    """
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_col)
    out = source.mapInArrow(partial(_round, path=path), "id long, n_ids long, ids_crc32 long, same boolean, parity boolean")
    return out.withColumnRenamed("id", id_col)
