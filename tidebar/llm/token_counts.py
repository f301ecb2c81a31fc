"""Token counts by rank-synchronous merging of ragged numpy arrays.

A sentencepiece BPE model joins, again and again, the neighbouring symbols whose joined piece
ranks best. No piece of such a model has a blank mark behind another character, so a text falls
into pre-tokens, each a run of blank marks and what follows. The distinct new pre-tokens of a
slice of texts lie in one ragged array of symbols. Each round finds, for all sequences at once,
the best pair of each and joins it wherever it occurs in its sequence. Sequences without a pair
leave. The symbols that survive are the tokens; characters outside the vocabulary count as
their UTF-8 bytes (byte fallback).

Where joining one occurrence would make a better pair than the one being joined, only the first
occurrence is joined in that round, as one-at-a-time merging would do; so counts are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import resident, sliced

BLANK = "▁"
NONE = np.iinfo(np.int64).max
_PRETOKEN = re.compile(r" *[^ \n]+| +|\n")
#: Marks that end many words; a word and its marks are counted apart if no piece has one behind a letter.
_MARKS = ".,#%&*$!|"


class PieceTable:
    """Symbols, pair ranks and text rules of a sentencepiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = {i: sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(p.rstrip(BLANK) != p and p.strip(BLANK) or BLANK in p.strip(BLANK) or len(p) > 1 and "\n" in p for p in normal.values()):
            raise ValueError("pieces of this model reach over blanks or line feeds")
        if "".join(sp.encode(" a  b ", out_type=str)) != f"{BLANK * 2}a{BLANK * 2}b{BLANK}":
            raise ValueError("this model changes white space")
        self.marks = "".join(m for m in _MARKS if not any(a.isalpha() and b == m for p in normal.values() for a, b in zip(p, p[1:])))
        self.byte_fallback = any(sp.is_byte(i) for i in range(n))
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        rank = {normal[i]: r for r, i in enumerate(order)}
        symbol = {p: k for k, p in enumerate(rank)}
        for p in list(rank):
            for c in p:
                symbol.setdefault(c, len(symbol))
        self.width = len(symbol) + 1
        pairs = {}
        for p, r in rank.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (r, symbol[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.joined = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.of_char = np.full(0x110000, -1, np.int64)
        self.lone_cost = np.ones(0x110000, np.int64)
        code = np.arange(0x110000)
        utf8 = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        if self.byte_fallback:
            self.lone_cost = utf8.astype(np.int64)
        for p, k in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
                if p in rank:
                    self.lone_cost[ord(p)] = 1

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if it doesn't join) and the symbol it becomes."""
        if not len(self.keys) or not len(left):
            return np.full(len(left), NONE), np.zeros(len(left), np.int64)
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.joined[at]


def _alternate(chosen: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring chosen pairs, the first, third, ...: pairs that share no symbol."""
    at = np.arange(len(chosen))
    start = np.maximum.accumulate(np.where(chosen & ~np.concatenate([[False], chosen[:-1]]), at, -1))
    return chosen & ((at - start) % 2 == 0)


def _first_of_each(chosen: np.ndarray, seq: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(chosen)
    lead = np.zeros(len(chosen), bool)
    lead[at[np.unique(seq[at], return_index=True)[1]]] = True
    return lead


def count_pretokens(pieces: PieceTable, words: list[str]) -> np.ndarray:
    """Tokens of each pre-token; all are merged together, one rank a round and sequence."""
    code = np.frombuffer("".join(words).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    seq = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    sym, cost = pieces.of_char[code], pieces.lone_cost[code]
    out = np.zeros(len(words), np.int64)
    rank, joined = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
    inner = np.flatnonzero(seq[:-1] == seq[1:])
    rank[inner], joined[inner] = pieces.lookup(sym[inner], sym[inner + 1])
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        best = np.minimum.reduceat(rank, first)
        mine = np.repeat(best, np.diff(np.append(first, len(seq))))
        going = mine < NONE
        if not going.all():
            out += np.bincount(seq[~going], cost[~going], len(words)).astype(np.int64)
            sym, seq, cost, rank, joined, mine = (x[going] for x in (sym, seq, cost, rank, joined, mine))
        if not len(sym):
            break
        take = _alternate(rank == mine)
        single = False
        while True:
            kept = ~np.concatenate([[False], take[:-1]])
            merged, s, q = take[kept], np.where(take, joined, sym)[kept], seq[kept]
            r, j = rank[kept], joined[kept]
            same = np.append(q[:-1] == q[1:], False)
            r[~same] = NONE
            touched = np.flatnonzero((merged | np.append(merged[1:], False)) & same)
            r[touched], j[touched] = pieces.lookup(s[touched], s[touched + 1])
            better = touched[r[touched] < mine[kept][touched]]
            if single or not len(better) or int(take.sum()) == len(np.unique(seq[take])):
                break
            take = np.where(np.isin(seq, q[better]), _first_of_each(take, seq), take)
            single = True
        cost = np.where(take, 1, cost)[kept]
        sym, seq, rank, joined = s, q, r, j
    return out


class TokenCounter:
    """counts(texts): tokens of whole texts. Counts of pre-tokens are kept, up to ``limit`` of them."""

    def __init__(self, path: str, limit: int = 400_000):
        self.pieces, self.limit, self.known = PieceTable(path), limit, {}

    def _learn(self, words: list[str]) -> None:
        bare = [w.rstrip(self.pieces.marks) for w in words]
        split = [(w, b) for w, b in zip(words, bare) if b != w and b[-1:].isalpha()]
        whole = {w for w, b in zip(words, bare) if b == w or not b[-1:].isalpha()}
        parts = list(whole.union(b for _, b in split).union(w[len(b) :] for w, b in split).difference(self.known))
        self.known.update(zip(parts, count_pretokens(self.pieces, parts).tolist()))
        self.known.update((w, self.known[b] + self.known[w[len(b) :]]) for w, b in split)

    def counts(self, texts: list[str]) -> list[int]:
        cut = [_PRETOKEN.findall(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = set().union(*cut)
        self._learn(list(new))
        return [sum(map(self.known.__getitem__, words)) for words in cut]


def count_tokens(docs: DataFrame, model: str, max_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, without begin, end or other added tokens.

    ``model`` is the path of a sentencepiece BPE model on the executors. Returns id, n_bytes
    (UTF-8), n_tokens and over_limit (n_tokens > max_tokens) for each row; other columns of
    ``docs`` are not read. Null and empty texts have 0 bytes and 0 tokens; rows that repeat and
    null ids are kept as they are; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident("pieces", model, make=lambda: TokenCounter(model))
        for batch, texts in sliced(batches, "text"):
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > max_tokens for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
