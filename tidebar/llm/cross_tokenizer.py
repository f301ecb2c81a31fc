"""Alignment of two tokenizers' tokens over whole texts, by intervals of bytes in DuckDB.

1. A task cuts texts before blanks that stand alone; no token of either tokenizer reaches over
   such a cut, so a text is a list of words, and its alignment is that of its words, one after the
   other. Each word is encoded and aligned once in a worker.
2. The new words of an Arrow slice become two interval tables (id, byte from, byte to) in DuckDB.
   An ASOF join finds, for each token of B, the token of A that ends last at or before it: where both end
   together, a group ends. Window sums of these ends number the groups; a range join lists the
   overlapping pairs, which are the links, or those of them that end together.
3. A block of documents leaves the task as one row: the words of each document, the id pairs of
   each word, and how often the block holds each pair. Spark adds the partial counts of all blocks,
   finds the highest count of each B id, and sends the totals back to the blocks that hold the pair.
   A block has about ``BLOCK_BYTES`` of text, or one longer text, however large the table, and less where its words
   bring those that the worker keeps above ``WORDS_KEPT``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, resident, sliced, workdir
from .token_counts import BLANK
from .tokens import _ALPHABET, WordEncoder, cut, hashed

#: Bytes of text of a block, and blocks of a file: what a task holds of blocks while it writes or reads them, however many it makes.
BLOCK_BYTES, BLOCKS_A_FILE = 8_000_000, 4
#: Words that a worker keeps before it begins anew, and words that DuckDB aligns at a time.
WORDS_KEPT, WORDS_LEARNT = 150_000, 10_000

# Tables a and b: word, id, lo, hi. Words follow one another in bytes, so lo and hi alone order all tokens.
_MEETS = "create or replace temp table meets as select b.hi from b asof join a on b.hi >= a.hi where b.hi = a.hi"
_GROUPS = """
with tokens as (
  select 0 as side, a.*, (meets.hi is not null)::int as ending from a left join meets using (hi)
  union all select 1, b.*, (meets.hi is not null)::int from b left join meets using (hi)),
numbered as (select *, coalesce(sum(ending) over (partition by side order by hi rows between unbounded preceding and 1 preceding), 0)::bigint as g from tokens)
select word, side, id, g from numbered order by g, side, hi
"""
_LINKS = """
with shared as materialized (select a.word, a.id as a, b.id as b, a.hi as a_hi, b.hi as b_hi from a join b on a.lo < b.hi and b.lo < a.hi)
select word, a, b from shared where {which} order by word
"""
_WHICH = {"end": "a_hi = b_hi", "overlap": "true"}


class Aligner:
    """Words met so far in this worker, each with its counts, its groups as text and its links (pairs of ids)."""

    def __init__(self, path_a: str, path_b: str, links: str):
        import duckdb
        import sentencepiece

        self.a, self.b = WordEncoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.library.encode_special_tokens = True  # their strings in a text are plain text
        if self.a.kind != "byte":
            raise ValueError("A has to be a byte-level tokenizer")
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("pieces of B reach over blanks")
        byte = {c: v for v, c in _ALPHABET.items()}
        self.bytes_a = {k: bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode() for p, k in self.a.library.get_vocab().items()}
        self.bytes_b = {k: bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)}
        self.shown = [str(k) for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.links = _LINKS.format(which=_WHICH[links])
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.good, self.text = np.zeros(0, bool), []
        self.counts = np.zeros((0, 3), np.int64)
        self.start, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pair = np.zeros(0, np.int64)  # a << 32 | b, word by word

    def _intervals(self, name: str, ids: list[list[int]], of: dict[int, bytes], good: list[bool]) -> None:
        kept = [x if g else [] for x, g in zip(ids, good)]
        flat = [k for x in kept for k in x]
        hi = np.cumsum(np.fromiter((len(of[k]) for k in flat), np.int64, len(flat)))
        lo = np.concatenate([np.zeros(1, np.int64), hi[:-1]])[: len(hi)]
        word = np.repeat(np.arange(len(ids), dtype=np.int64), [len(x) for x in kept])
        # a table of its own: registered Arrow data has no statistics to plan joins by
        self.sql.register("given", pa.table({"word": word, "id": pa.array(flat, pa.int64()), "lo": lo, "hi": hi}))
        self.sql.execute(f"create or replace temp table {name} as select * from given")
        self.sql.unregister("given")

    def _described(self, groups: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, list[str]]:
        """n_a, n_b and n_groups of each word, and its groups as text, from tokens in the order of groups, sides and bytes."""
        word, side, g = (np.asarray(groups[c], np.int64) for c in ("word", "side", "g"))
        new_word, new_group = np.diff(word, prepend=-1) != 0, np.diff(g, prepend=-1) != 0
        new_side = np.diff(side, prepend=0) == 1
        counts = np.column_stack([np.bincount(word[side == 0], minlength=n), np.bincount(word[side == 1], minlength=n), np.bincount(word[new_group], minlength=n)])
        marks = np.select([new_word, new_group, new_side], [0, 1, 2], 3).tolist()
        parts = [("", ";", "|", ",")[m] + self.shown[k] for m, k in zip(marks, groups["id"].tolist())]
        upto = np.searchsorted(word, np.arange(n + 1)).tolist()
        return counts, ["".join(parts[a:b]) for a, b in zip(upto, upto[1:])]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids_a = self.a.encode_words(words)
        ids_b = self.b.encode([w[1:] for w in words], num_threads=1)  # B puts the blank before by itself
        raw = [w.encode() for w in words]
        good = [b"".join(map(self.bytes_a.__getitem__, a)) == r == b"".join(map(self.bytes_b.__getitem__, b)) for a, b, r in zip(ids_a, ids_b, raw)]
        self._intervals("a", ids_a, self.bytes_a, good)
        self._intervals("b", ids_b, self.bytes_b, good)
        self.sql.execute(_MEETS)
        groups = self.sql.execute(_GROUPS).fetchnumpy()
        links = self.sql.execute(self.links).fetchnumpy()
        first = len(self.text)
        counts, text = self._described(groups, len(words))
        n = np.bincount(np.asarray(links["word"], np.int64), minlength=len(words))
        self.start = np.concatenate([self.start, len(self.pair) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.pair = np.concatenate([self.pair, np.asarray(links["a"], np.int64) << 32 | np.asarray(links["b"], np.int64)])
        self.good, self.counts = np.concatenate([self.good, np.array(good, bool)]), np.concatenate([self.counts, counts])
        self.text += text
        where = np.searchsorted(self.known, hashes)  # both are sorted
        self.slot = np.insert(self.slot, where, np.arange(first, first + len(words), dtype=np.int32))
        self.known = np.insert(self.known, where, hashes)

    def slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every word of all texts, and the number of words of each text."""
        raw, start, end, n_words = cut([" " + t if t else "" for t in texts], "blank")
        distinct, first, back = np.unique(hashed(np.frombuffer(raw, np.uint8), start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            unknown, place = distinct[new], first[new]
            for k in range(0, len(unknown), WORDS_LEARNT):
                few = place[k : k + WORDS_LEARNT]
                self._learn(unknown[k : k + WORDS_LEARNT], [raw[i:j].decode() for i, j in zip(start[few].tolist(), end[few].tolist())])
        return self.slot[np.searchsorted(self.known, distinct)][back], n_words


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All positions of runs (start, length), one run after the other."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


class Block:
    """Documents of one block, gathered slice by slice."""

    def __init__(self, task: int, k: int):
        self.number, self.bytes = task << 32 | k, 0
        self.ids, self.words, self.shas, self.n_words, self.counts = [], [], [], [], []

    def add(self, aligner: Aligner, ids: pa.Array, texts: list[str], size: int) -> None:
        slots, n_words = aligner.slots(texts)
        upto = np.concatenate([[0], np.cumsum(n_words)])
        bad = np.concatenate([[0], np.cumsum(~aligner.good[slots])])
        clean = (bad[upto[1:]] == bad[upto[:-1]]) & (n_words > 0)
        of_words = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(np.column_stack([aligner.counts[slots], aligner.n[slots]]), axis=0)])
        self.counts.append(np.where(clean[:, None], of_words[upto[1:]] - of_words[upto[:-1]], 0))
        names = aligner.text
        for a, b, c in zip(upto[:-1].tolist(), upto[1:].tolist(), clean.tolist()):
            self.shas.append(hashlib.sha256(";".join([names[s] for s in slots[a:b].tolist()]).encode()).hexdigest() if c else "")
        self.ids.append(ids)
        self.n_words.append(np.where(clean, n_words, 0))
        self.words.append(slots[np.repeat(clean, n_words)])
        self.bytes += size

    def row(self, aligner: Aligner, kind: pa.DataType) -> pa.RecordBatch:
        words, place = np.unique(np.concatenate(self.words), return_inverse=True)
        n = aligner.n[words]
        pairs, at = np.unique(aligner.pair[_ranges(aligner.start[words], n)], return_inverse=True)
        often = np.bincount(place, minlength=len(words))
        total = np.bincount(at, np.repeat(often, n), len(pairs)).astype(np.int64)
        counts = np.concatenate(self.counts)
        held = pa.StructArray.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], names=["a", "b", "n"])
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        blob = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
        ids = pa.concat_arrays([x.cast(kind) for x in self.ids])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.number], pa.int64()), whole(ids), *[whole(pa.array(np.ascontiguousarray(counts[:, k]))) for k in range(4)], whole(pa.array(self.shas, pa.string())),
                blob(np.concatenate(self.n_words), "<i4"), blob(place, "<i4"), blob(n, "<i4"), blob(at, "<i4"), whole(held),
            ],
            names=["block", "ids", "n_a", "n_b", "n_groups", "n_links", "shas", "n_words", "words", "n_pairs", "pair_of", "pairs"],
        )


_BLOCKS = "block long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, n_words binary, words binary, n_pairs binary, pair_of binary, pairs array<struct<a: int, b: int, n: long>>"


def _blocks(path_a: str, path_b: str, links: str, limit: int = WORDS_KEPT):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = resident("aligner", path_a, path_b, links, make=lambda: Aligner(path_a, path_b, links))
        task, k, block, kind = TaskContext.get().partitionId(), 0, None, None
        for batch, texts in sliced(batches, "text"):
            kind = batch.column(0).type
            block = block or Block(task, k)
            block.add(aligner, batch.column(0), texts, sum(map(len, texts)))
            if block.bytes >= BLOCK_BYTES or len(aligner.text) > limit:
                yield block.row(aligner, kind)
                block, k = None, k + 1
                if len(aligner.text) > limit:
                    aligner.clear()  # between blocks, whose words are slots
        if block:
            yield block.row(aligner, kind)
        if len(aligner.text) > limit:
            aligner.clear()

    return run


def _resolved(id_col: str):
    """Documents of a block, with what the counts of the corpus say about their links."""

    def run(blocks: pa.Table, totals: pa.Table) -> pa.Table:
        block = {c: blocks.column(c)[0] for c in blocks.column_names}
        of = lambda c: np.frombuffer(block[c].as_py(), "<i4").astype(np.int64)
        by = np.argsort(totals.column("pos").to_numpy())
        count, best = totals.column("count").to_numpy()[by], totals.column("best").to_numpy(zero_copy_only=False)[by].astype(np.int64)
        pair_of, n_pairs, words, n_words = of("pair_of"), of("n_pairs"), of("words"), of("n_words")

        def summed(x: np.ndarray) -> np.ndarray:
            a = np.concatenate([[0], np.cumsum(n_pairs)])
            upto = np.concatenate([[0], np.cumsum(x[pair_of])])
            b = np.concatenate([[0], np.cumsum(n_words)])
            over = np.concatenate([[0], np.cumsum((upto[a[1:]] - upto[a[:-1]])[words])])
            return over[b[1:]] - over[b[:-1]]

        plain = lambda c: block[c].values
        return pa.table(
            [plain("ids"), *[plain(c) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(summed(best)), pa.array(summed(count)), plain("shas")],
            names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        )

    return run


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, count, n (blocks that hold the pair), best (whether no A id is linked more often to that B id)."""
    counts = blocks.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"), F.count("*").alias("n"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", "n", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, links: str = "end", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: a row for each document, and the mapping of ids.

    ``path_a`` is a byte-level tokenizers file, which gets a blank and the text, ``path_b`` a
    sentencepiece BPE model, which puts that blank itself; special strings in texts are plain text. Links are the pairs of
    an A and a B token whose bytes end together, or, with ``links="overlap"``, that share a byte. Groups are cut where
    tokens of both end.

    Documents: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B
    id, ties included), count_sum (the frequencies of the pairs, over all links), groups_sha256 of
    ``a1,a2|b1;a3|b2,b3``. Mapping: a, b, count, best.

    Texts that are null or empty, and those that either tokenizer changes (the bytes of its tokens differ
    from those of blank and text), have zeros and '' and count nowhere. Rows that repeat count as often as they stand there; null
    ids are kept; other columns are not read; an empty table gives two empty ones.
    """
    spark, folder = docs.sparkSession, workdir(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks(path_a, path_b, links), _BLOCKS.format(kind=kind)), f"{folder}/blocks", BLOCKS_A_FILE)
    mapping = materialize(pair_counts(blocks), f"{folder}/mapping")
    held = blocks.select("block", F.posexplode("pairs").alias("pos", "pair")).select("block", "pos", "pair.a", "pair.b")
    totals = join_hot(held, mapping.select("a", "b", "count", "best"), ["a", "b"], "block", counts=mapping).select(F.col("block").alias("of"), "pos", "count", "best")
    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = blocks.drop("pairs").groupBy("block").cogroup(totals.groupBy("of")).applyInArrow(_resolved(id_col), schema)
    return out, mapping.drop("n")
