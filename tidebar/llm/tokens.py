"""Exact token ids of whole texts, through a tokenizers file, with each distinct word encoded once.

A byte-pair tokenizer never joins symbols across the borders its pre-tokenizer draws. Where a
text is cut at such borders, the ids of the parts, one after the other, are the ids of the text.
So a task cuts texts into words, lets the library encode the words it has not met, and gathers
the ids of whole texts from a table of words, in numpy. Words are told apart by 64-bit hashes:
among the millions a task meets, two share one with a probability below 1e-6. When the table holds
``limit`` words, those used least are forgotten; memory is bounded, and results don't depend on it.

Two cuts are known to be exact, and others are refused:

* pre-tokenizers that drop white space (kind ``drop``): cut at blanks and line feeds;
* byte-level pre-tokenizers (kind ``byte``), whose words carry the blank before them: cut before
  a blank or line feed that stands alone between characters that surely are no white space.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np

from .common import quiet_tokenizers, resident
from .sketching import _BYTE, _STEP, _power_tables, mix

#: Marks that end many words; pre-tokenizers part letters from them.
_MARKS = ".,#%&*$!|"
_DROPPING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()
_BLANK = _ALPHABET[0x20]
#: ASCII bytes that may be white space to some library, and first bytes of characters of which some are.
_BLANKISH = np.zeros(256, bool)
_BLANKISH[: 0x21] = _BLANKISH[0x7F] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _visible(word: str) -> str:
    return word.encode().decode("latin-1").translate(_ALPHABET)


def cut_kind(spec: dict) -> str:
    """Which exact cut a tokenizers file allows; ValueError if none is known."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] or "\n" in t["content"] for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens that reach over white space")
    if pre.get("type") == "ByteLevel" and norm is None and not pre.get("add_prefix_space") and pre.get("use_regex", True):
        return "byte"
    first = (pre.get("pretokenizers") or [{}])[0]
    if pre.get("type") == "Sequence" and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and first["pattern"].get("Regex") == _DROPPING:
        return "drop"
    raise ValueError(f"no exact cut is known for this pre-tokenizer: {pre}")


def cut(texts: list[str], kind: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as bytes, the start and end of each word, and the number of words of each text.

    Kind ``blank`` is kind ``byte`` without cuts before line feeds.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join([*parts, b""])
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)  # of each text with the \n behind it
    if kind == "drop":
        edge = np.flatnonzero(np.diff((data != 0x20) & (data != 0x0A), prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        return raw, start, end, np.diff(np.searchsorted(start, ends), prepend=0)
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])[: len(parts)]
    blank = np.flatnonzero((data == 0x20) | (data == 0x0A) & (kind == "byte"))
    blank = blank[(blank > 0) & (blank < len(data) - 1)]
    before, after = data[blank - 1], data[blank + 1]
    lone = ~_BLANKISH[before] & ~_BLANKISH[after] & ~_LEADS[after]
    late = before >= 0x80  # the last byte of a longer character: was its first byte a suspect?
    lone[late] &= ~(_LEADS[data[np.maximum(blank[late] - 2, 0)]] | _LEADS[data[np.maximum(blank[late] - 3, 0)]])
    start = blank[lone]
    start = start[ends[np.minimum(np.searchsorted(ends, start + 1), len(ends) - 1)] != start + 1]
    start = np.sort(np.concatenate([start, begins[ends - 1 > begins]]))
    start = start[np.append(True, start[1:] != start[:-1])[: len(start)]]
    owner = np.searchsorted(ends, start, side="right")
    end = np.append(start[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True) if len(start) else np.zeros(0, bool)
    end = end[: len(start)]
    end[last] = ends[owner[last]] - 1
    return raw, start, end, np.bincount(owner, minlength=len(parts))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of a byte array, as differences of prefix sums."""
    power, inverse = _power_tables(len(data))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    return mix((upto[end] - upto[start]) * inverse[start] + (end - start).astype(np.uint64) * _STEP)


class WordEncoder:
    """encode(texts) gives the ids of all texts in one flat array and the number of ids of each."""

    def __init__(self, path: str, limit: int = 800_000):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.kind = cut_kind(json.load(f))
        self.library, self.limit = Tokenizer.from_file(path), limit
        self.known = np.zeros(0, np.uint64)
        self.ids = np.zeros(0, np.uint32)
        self.start, self.length, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.stems: dict[str, list[int]] = {}
        self.letters: dict[str, bool] = {}

    def _keep(self, rows: np.ndarray) -> None:
        length = self.length[rows]
        ends = np.cumsum(length)
        self.ids = self.ids[np.arange(int(length.sum())) + np.repeat(self.start[rows] - (ends - length), length)]
        self.known, self.start, self.length, self.used = self.known[rows], ends - length, length, self.used[rows] // 2

    def _ends_word(self, c: str) -> bool:
        if c not in self.letters:
            normal = self.library.normalizer
            self.letters[c] = c.isalpha() and (normal is None or normal.normalize_str(c)[-1:].isalpha())
        return self.letters[c]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words. A word of letters and end marks takes the ids of its letters, then of its marks.

        That needs a last letter whose normal form ends with a letter too: that of U+0130 ends with a
        combining mark, and pre-tokenizers leave it with the marks behind.
        """
        if len(self.stems) > self.limit // 6:
            self.stems.clear()
        lower = self.kind == "drop"
        split = []
        for w in words:
            b = w.rstrip(_MARKS)
            if not self._ends_word(b[-1:]):
                b = w
            split.append((b.lower() if lower and b.isascii() and b.isalpha() else b, w[len(b) :]))
        new = list({p for s in split for p in s}.difference(self.stems))
        rest, tokenize = [], self.library.model.tokenize
        for w in new:
            core = w[1:] if w[:1] == " " else w
            if core.isalpha() and (core.isascii() or max(core) < "Ā"):
                # the model alone for Latin-1 letters, which the library's other steps leave as one pre-token
                core = core.lower() if lower else core
                seen = core if core.isascii() else _visible(core)
                self.stems[w] = [x.id for x in tokenize(_BLANK + seen if w[:1] == " " else seen)]
            else:
                rest.append(w)
        self.stems.update(zip(rest, (e.ids for e in self.library.encode_batch_fast(rest, add_special_tokens=False))))
        return [self.stems[a] + self.stems[b] for a, b in split]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = self.encode_words(words)
        length = np.fromiter(map(len, found), np.int64, len(found))
        # both are sorted, so the new ones are put between the old ones
        at = np.searchsorted(self.known, hashes)
        self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.used = np.insert(self.used, at, 0)
        self.known = np.insert(self.known, at, hashes)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw, start, end, n_words = cut(texts, self.kind)
        h = hashed(np.frombuffer(raw, np.uint8), start, end)
        by = np.argsort(h)
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[by[1:]] != h[by[:-1]]
        first, back = by[fresh], np.empty(len(h), np.int64)
        distinct = h[first]
        back[by] = np.cumsum(fresh) - 1
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            if len(self.known) + int(new.sum()) > self.limit:
                needed = np.zeros(len(self.known), bool)
                needed[at[~new]] = True
                score = np.where(needed, np.iinfo(np.int64).max, self.used)
                keep = np.argsort(-score, kind="stable")[: max(self.limit // 2, int(needed.sum()))]
                self._keep(np.sort(keep[score[keep] > 1]))
            a, b = start[first[new]].tolist(), end[first[new]].tolist()
            self._learn(distinct[new], [raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip(a, b)])
        at = np.searchsorted(self.known, distinct)
        self.used[at] += np.bincount(back, minlength=len(distinct))
        slots = at[back]
        length = self.length[slots]
        ends = np.cumsum(length)
        ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[slots] - (ends - length), length)]
        upto_text = np.concatenate([[0], ends])[np.cumsum(n_words)] if len(texts) else np.zeros(0, np.int64)
        return ids, np.diff(upto_text, prepend=0)


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; its table of words serves its next tasks, until another operator needs the memory."""
    return resident("encoder", path, make=lambda: WordEncoder(path))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``end_id`` behind the ids of each document."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
