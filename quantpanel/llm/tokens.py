"""Fast exact encoding with a lower-casing BPE of words that drops white space, such as `word_bpe_49k.json`.

A text is cut at U+0020 and U+000A. Each distinct piece is encoded once, by the tokenizer itself and in batches, and kept in a
bounded cache; when it is full, the pieces of the texts at hand stay. A word with marks behind it is the word and the marks. Texts of Latin-1 letters without the "<|" of special tokens are lower-cased first and lose the stop or comma behind a word to a piece of its own, which
makes far fewer distinct pieces; the tokenizer does both anyway. tests/llm compare the ids with those of whole texts.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import filterfalse

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from quantpanel.llm.common import CLEARED

CACHE_PIECES = 500_000
#: A word and ASCII marks behind it, which the tokenizer takes apart; an apostrophe may begin an ending instead.
WORD_AND_MARKS = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch
#: A stop or comma at a piece's end that has no letter before it.
SMALL_LETTERS = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
LOOSE_MARK = re.compile(r"[.,](?<![a-zà-öø-ÿ][.,])(?=[ \n]|\Z)")


def latin(text: str) -> bool:
    """Whether all characters are of Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes.

    mark: a special token and its id, put between pieces that share a call; a piece that contains it goes alone.
    """

    def __init__(self, path: str, mark: tuple[str, int]) -> None:
        self.tokenizer, self.mark = Tokenizer.from_file(path), mark
        # for pieces of small letters only: the same model, without the work that leaves such pieces as they are
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    @staticmethod
    def _ids(tokenizer: Tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _cut(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray, gap: int) -> bool:
        """Gives each piece its stretch of ids; ends: where stretches end; gap: ids between two. False if the numbers differ."""
        if len(ends) != len(pieces):
            return False
        data, ends = ids.tobytes(), (4 * ends).tolist()
        self.known.update(zip(pieces, (data[a:b] for a, b in zip([0, *(x + 4 * gap for x in ends[:-1])], ends, strict=True)), strict=True))
        return True

    def _learn(self, new: set[str]) -> None:
        text, special = self.mark
        is_word = lambda p: p.islower() and p.isalpha() if p.isascii() else SMALL_LETTERS(p)
        words = set(filter(is_word, new))
        rest = new - words
        pairs = [(m[0], m[1], m[2]) for m in map(WORD_AND_MARKS, rest) if m]
        rest.difference_update(p for p, _, _ in pairs)
        words.update(w for _, w, _ in pairs if w not in self.known)
        rest.update(m for _, _, m in pairs if m not in self.known)
        words = list(words)
        for i in range(0, len(words), 2_000):
            part = words[i : i + 2_000]
            ids = self._ids(self.letters, " ".join(part))
            if not self._cut(part, ids, np.flatnonzero(self.last[ids]) + 1, 0):
                rest.update(part)
        together = [p for p in rest if text not in p]
        for i in range(0, len(together), 2_000):
            part = together[i : i + 2_000]
            ids = self._ids(self.tokenizer, text.join(part))
            self._cut(part, ids, np.append(np.flatnonzero(ids == special), len(ids)), 1)
        for p in rest:
            if p not in self.known:
                self.known[p] = self._ids(self.tokenizer, p).tobytes()
        for p, word, marks in pairs:
            self.known[p] = self.known[word] + self.known[marks]

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if "<|" not in text and (text.isascii() or latin(text)):  # special tokens are told apart by case
            small = text.lower()
            text = small
            if not LOOSE_MARK.search(small):
                text = (small + " ").replace("\n", " ").replace(". ", " . ").replace(", ", " , ")
                return text.split(" ")
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._pieces(t) for t in texts]
        new: set[str] = set()
        for pieces in split:
            new.update(filterfalse(self.known.__contains__, pieces))
        if len(self.known) + len(new) > CACHE_PIECES:
            held = set().union(*split) - new
            self.known = {"": b""} | {p: self.known[p] for p in held}
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


@cache
def word_encoder(path: str, mark: tuple[str, int]) -> WordEncoder:
    """One a Python worker."""
    return WordEncoder(path, mark)


CLEARED.append(word_encoder.cache_clear)
