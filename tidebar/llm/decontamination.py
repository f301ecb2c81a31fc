"""Benchmark decontamination by suffix arrays over shards of the corpus.

Benchmark and corpus are sequences of lower-cased words. Each task takes its documents shard by
shard, builds a word-level suffix array of the shard, and binary-searches every
suffix of every benchmark item in it, all at once in numpy. That gives each benchmark suffix its
longest verbatim match and the locations of its window in the shard. A word that the benchmark
does not have ends every match, so suffixes whose run of benchmark words is shorter than the
shortest window can't hold one and are left out of the array.

The benchmark is cut into blocks of about ``BLOCK_CHARS`` characters, longer items into overlapping parts. Tasks sort the
blocks and write them; the driver only hands on, block by block, what is broadcast, ``PASSES`` of them in one stage. A benchmark of more
blocks takes several stages, each of which writes what it found, by digests of texts, and no text. None shuffles texts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot, let_go, materialize, sliced, workdir

#: Characters of benchmark text of a broadcast block, and blocks that are broadcast at a time.
BLOCK_CHARS, PASSES = 8_000_000, 2

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Benchmark:
    """A block of benchmark items: word numbers from 1, all items behind one another, each closed by 0.

    ``start`` has the suffixes that hold a window, one for each different window, so a passage that
    many items share is looked for once; ``items_of`` lists the items of each.
    """

    def __init__(self, items: list[tuple[int, str]], window: int):
        cut = [(i, w) for i, t in items if (w := words_of(t or ""))]
        self.vocabulary = {w: k for k, w in enumerate(sorted(set(chain.from_iterable(w for _, w in cut))), 1)}
        self.words = np.array([x for _, w in cut for x in (*map(self.vocabulary.__getitem__, w), 0)], np.int32)
        size = np.array([len(w) for _, w in cut], np.int64)
        width = np.minimum(size, window)
        n = size - width + 1
        owner = np.repeat(np.arange(len(cut)), n)
        start = np.arange(int(n.sum())) + np.repeat(np.cumsum(size + 1) - size - 1 - (np.cumsum(n) - n), n)
        width = width[owner]
        #: all suffixes with a window, in order
        self.suffixes = suffix_order(self.words, start)
        by = np.argsort(start)
        place = by[np.searchsorted(start[by], self.suffixes)]
        owner, width, start = owner[place], width[place], self.suffixes
        alike = common_prefix(self.words, start[1:], self.words, start[:-1]) >= np.maximum(width[1:], width[:-1])
        fresh = np.append(True, ~(alike & (width[1:] == width[:-1])))[: len(start)]
        self.start, self.width = start[fresh], width[fresh]
        pair = np.unique(np.stack([np.cumsum(fresh) - 1, owner]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
        self.bounds = np.searchsorted(pair[0], np.arange(len(self.start) + 1))
        #: the items of each window, as text; None without an id
        self.owner = np.array([None if cut[k][0] is None else str(cut[k][0]) for k in pair[1].tolist()], object)
        self.depth = int(size.max(initial=0)) + 1
        self.shortest = int(self.width.min(initial=window))

    def items_of(self, windows: np.ndarray) -> set[str]:
        return {i for k in windows.tolist() for i in self.owner[self.bounds[k] : self.bounds[k + 1]] if i is not None}


def suffix_order(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The positions ``at`` in the order of the suffixes of ``words`` there, up to the first 0 of each, by doubling."""
    run, rank, k = _run_lengths(words), words.astype(np.int64), 1
    while len(words) and k < int(run.max(initial=0)):
        second = np.where(run > k, rank[np.minimum(np.arange(len(words)) + k, len(words) - 1)], 0)
        by = np.lexsort((second, rank))
        fresh = (rank[by[1:]] != rank[by[:-1]]) | (second[by[1:]] != second[by[:-1]])
        rank = np.empty(len(words), np.int64)
        rank[by] = np.append(0, np.cumsum(fresh))
        k *= 2
    return at[np.argsort(rank[at], kind="stable")]


def suffix_array(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` in the order of the suffixes of ``words`` there, compared up to ``depth`` words or the first 0.

    Sorted by blocks of words packed into one number; only suffixes that tie so far are compared further.
    """
    order = at.copy()
    bits = max(1, int(words.max(initial=0)).bit_length())
    per, done = 62 // bits, 0
    tied, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    while len(tied) and done < depth:
        key, going = np.zeros(len(tied), np.int64), np.ones(len(tied), bool)
        for k in range(per):
            word = np.where(going, words[np.minimum(order[tied] + done + k, len(words) - 1)], 0)
            going &= word > 0
            key = (key << bits) | word
        by = np.lexsort((key, group))
        order[tied], key, group, going = order[tied][by], key[by], group[by], going[by]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        alone = fresh & np.append(fresh[1:], True)
        more = ~alone & going
        tied, group = tied[more], np.cumsum(fresh)[more]
        done += per
    return order


def common_prefix(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that a from i and b from j have in common, up to the first 0; both end with 0."""
    n = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        x, y = a[i[live] + n[live]], b[j[live] + n[live]]
        live = live[(x == y) & (x > 0)]
        n[live] += 1
    return n


def search(words: np.ndarray, order: np.ndarray, test: np.ndarray, at: np.ndarray, width: np.ndarray | None = None, after: bool = False) -> np.ndarray:
    """Binary search of the test suffixes ``at`` in the suffix array: how many shard suffixes sort before each.

    With ``width``, suffixes that agree in that many words count as equal, and as before if ``after``.
    """
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        i, j = order[mid], at[open_]
        n = common_prefix(words, i, test, j)
        before = words[i + n] < test[j + n]
        if width is not None:
            before = np.where(n >= width[open_], after, before)
        low[open_] = np.where(before, mid + 1, low[open_])
        high[open_] = np.where(before, high[open_], mid)
    return low


def longest_matches(words: np.ndarray, order: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """For each benchmark window start: words of its suffix's longest verbatim match in the shard, and a place of it (-1: none)."""
    best, place = np.zeros(len(bench.start), np.int64), np.full(len(bench.start), -1, np.int64)
    if len(order):
        low = search(words, order, bench.words, bench.start)
        for side in (low - 1, low):
            ok = (side >= 0) & (side < len(order))
            at = order[np.clip(side, 0, len(order) - 1)]
            n = np.where(ok, common_prefix(words, at, bench.words, bench.start), 0)
            place = np.where(n > best, at, place)
            best = np.maximum(best, n)
    return best, place


def longest_at(words: np.ndarray, at: np.ndarray, bench: Benchmark) -> np.ndarray:
    """Words of the longest match of each place of the shard with any suffix of the benchmark that holds a window."""
    low = search(bench.words, bench.suffixes, words, at)
    best = np.zeros(len(at), np.int64)
    for side in (low - 1, low):
        ok = (side >= 0) & (side < len(bench.suffixes))
        near = bench.suffixes[np.clip(side, 0, len(bench.suffixes) - 1)]
        best = np.maximum(best, np.where(ok, common_prefix(words, at, bench.words, near), 0))
    return best


def _runs(pairs: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Of sorted (key, value) columns: the keys, and the values of each."""
    key, value = pairs
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first].tolist(), np.split(value, first[1:])


def _run_lengths(words: np.ndarray) -> np.ndarray:
    """Words from each position to the next 0."""
    at = np.arange(len(words))
    stop = np.where(words == 0, at, len(words))
    return np.minimum.accumulate(stop[::-1])[::-1] - at


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search_pass(shared):
    """One pass: adds the spans hit by the block's windows and the ids of items found to what earlier passes found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        bench = shared.value
        get = bench.vocabulary.get
        for batch, texts in sliced(batches, "text"):
            cut = list(map(words_of, texts))
            n = np.fromiter(map(len, cut), np.int64, len(cut))
            begin = np.cumsum(n + 1) - n - 1
            words = np.fromiter(map(get, chain.from_iterable(chain(w, (b"",)) for w in cut), repeat(0)), np.int32, int((n + 1).sum()))
            order = suffix_array(words, np.flatnonzero(_run_lengths(words) >= bench.shortest), bench.depth)
            match, _ = longest_matches(words, order, bench)
            spans = [list(x or ()) for x in batch.column(3).to_pylist()]
            items = [set(x or ()) for x in batch.column(4).to_pylist()]
            longest = np.array(batch.column(5).to_pylist(), np.int64)
            hit = np.flatnonzero(match >= bench.width)
            if len(hit):
                test, width = bench.start[hit], bench.width[hit]
                low, high = (search(words, order, bench.words, test, width, after) for after in (False, True))
                count = high - low
                at = order[np.arange(int(count.sum())) + np.repeat(low - (np.cumsum(count) - count), count)]
                wide, window = np.repeat(width, count), np.repeat(hit, count)
                doc = np.searchsorted(begin, at, side="right") - 1
                np.maximum.at(longest, doc, longest_at(words, np.unique(at), bench)[np.unique(at, return_inverse=True)[1]])
                pairs = np.unique(np.stack([doc, window]), axis=1)
                for d, mine in zip(*_runs(pairs)):
                    items[d] |= bench.items_of(mine)
                for d, s, e in _merged(doc, at - begin[doc], wide):
                    spans[d].append({"start": s, "end": e})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(spans, _SPAN), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(longest)],
                schema=pa.schema([("id", batch.column(0).type), ("text", pa.string()), ("n_words", pa.int64()), ("spans", _SPAN), ("items", pa.list_(pa.string())), ("longest", pa.int64())]),
            )

    return run


def _merged(doc: np.ndarray, start: np.ndarray, width: np.ndarray) -> list[tuple[int, int, int]]:
    """Overlapping or touching word spans of each document, joined."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + width)[order]
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + doc * big) - doc * big
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return list(zip(doc[first].tolist(), start[first].tolist(), reach[last].tolist()))


def _parts(item: str | None, text: str | None, window: int, limit: int) -> list[tuple[str | None, str, int]]:
    """An item, or the parts of a long one, with the bytes of each: every window lies in one part, and no part is shorter than a window."""
    if len(text or "") <= limit:
        return [(item, text or "", len(text or ""))]
    words = words_of(text)
    if len(words) <= window:
        return [(item, text, len(text))]
    each = max(1, limit * len(words) // len(text))  # words of about a block
    parts = (b" ".join(words[k : k + each + window - 1]).decode("utf-8", "surrogatepass") for k in range(0, len(words) - window + 1, each))
    return [(item, p, len(p)) for p in parts]


def _sorted_blocks(window: int, limit: int):
    """Blocks of the items of a task, sorted and pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        block, held = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Benchmark(block, window), pickle.HIGHEST_PROTOCOL)], pa.large_binary()).cast(pa.binary())], names=["block"])

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, part, size in _parts(item, text, window, limit):
                    if block and held + size > limit:
                        yield made()
                        block, held = [], 0
                    block.append((i, part))
                    held += size
        if block:
            yield made()

    return run


def _blocks(bench: DataFrame, id_col: str, text_col: str, unnamed: bool, window: int, folder: str) -> DataFrame:
    """One row a block: number and pickled ``Benchmark``. Items are dealt evenly over as many tasks as there are blocks to make."""
    named = bench.filter(bench[id_col].isNotNull() | F.lit(unnamed)).select(bench[id_col].cast("string").alias("id"), bench[text_col].alias("text"))
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    made = named.repartition(-(-total // BLOCK_CHARS) or 1).mapInArrow(_sorted_blocks(window, BLOCK_CHARS), "block binary")
    return materialize(made.withColumn("number", F.monotonically_increasing_id()), f"{folder}/blocks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", unnamed: bool = False) -> DataFrame:
    """Verbatim benchmark windows in whole documents.

    A window is ``window`` words running of an item; an item of fewer words, but not none, is one
    window. Returns for each row of ``docs``: id, n_words, spans (word ranges inside occurrences
    of windows, end exclusive; the spans of several passes may overlap), items (ids of items found,
    as text, sorted) and longest (words of the longest match that holds a window, else 0; matches end where an item
    of more than ``BLOCK_CHARS`` characters is cut). Null texts have no words; items
    without words are left out, and so are those without id, but for ``unnamed``: then their
    windows count in spans and longest, and only items can't list them; rows that repeat are each answered; other columns are not
    read; empty tables give no rows, or no spans.
    """
    spark = docs.sparkSession
    kind, folder = docs.schema[id_col].dataType, workdir(spark)
    schema = T.StructType.fromDDL("text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest long")
    schema = T.StructType([T.StructField("id", kind), *schema.fields])
    fresh = lambda id_, text: docs.select(id_.alias("id"), text.alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(0).cast("long").alias("longest"))
    text = docs[text_col]
    digest = F.struct(F.xxhash64(text).alias("d"), F.xxhash64(text, F.lit(1)).alias("e"))

    def passed(df: DataFrame, held: list, schema: T.StructType) -> DataFrame:
        for block in held:
            df = df.mapInArrow(_search_pass(block), schema)
        return df

    blocks = _blocks(benchmark, item_col, item_text_col, unnamed, window, folder)
    numbers = sorted(r.number for r in blocks.select("number").collect())  # a row a block
    load = lambda n: spark.sparkContext.broadcast(pickle.loads(blocks.filter(F.col("number") == n).first().block))
    by_text = T.StructType([T.StructField("id", T.StructType.fromDDL("d long, e long")), *schema.fields[1:]])
    early = []
    for k in range(0, len(numbers) - PASSES, PASSES):
        held = [load(n) for n in numbers[k : k + PASSES]]
        hits = passed(fresh(digest, text), held, by_text).filter(F.size("spans") > 0).dropDuplicates(["id"]).select("id.d", "id.e", "spans", "items", "longest")
        early.append(materialize(hits, f"{folder}/pass-{k}"))
        for old in held:
            old.destroy()
    held = [load(n) for n in numbers[len(early) * PASSES :]] or [spark.sparkContext.broadcast(Benchmark([], window))]
    if not early:
        return passed(fresh(docs[id_col], text), held, schema).select(F.col("id").alias(id_col), "n_words", "spans", "items", "longest")
    both = T.StructType([T.StructField("id", T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("d long, e long").fields])), *schema.fields[1:]])
    last = passed(fresh(F.struct(docs[id_col].alias("id"), digest["d"].alias("d"), digest["e"].alias("e")), text), held, both)
    last = materialize(last.select("id.id", "id.d", "id.e", "n_words", "spans", "items", "longest"), f"{folder}/last")
    before = reduce(DataFrame.unionAll, early).groupBy("d", "e").agg(F.flatten(F.collect_list("spans")).alias("spans0"), F.flatten(F.collect_list("items")).alias("items0"), F.max("longest").alias("longest0"))
    found = join_hot(last, materialize(before, f"{folder}/before"), ["d", "e"], "id", "left")  # copies of a text may be many
    none = F.expr("cast(array() as array<struct<start:long,end:long>>)"), F.expr("cast(array() as array<string>)")
    return found.select(
        F.col("id").alias(id_col), "n_words", F.concat("spans", F.coalesce("spans0", none[0])).alias("spans"),
        F.sort_array(F.array_distinct(F.concat("items", F.coalesce("items0", none[1])))).alias("items"), F.greatest("longest", F.coalesce("longest0", F.lit(0))).alias("longest"),
    )


def hit_words(spans: str = "spans"):
    """Column: distinct words inside the spans."""
    ordered = F.array_sort(spans)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], s["end"]).alias("reach"))
    return F.aggregate(ordered, zero, step, lambda acc: acc["n"])


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", unnamed: bool = False) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark, with all their columns; ``unnamed`` as in find_leaks.

    Rows with a null id, and rows that repeat an id, are each judged by their own text.
    """
    own = docs.withColumn("__row", F.struct(*[docs[c] for c in docs.columns]))
    found = find_leaks(own.select(F.col("__row"), docs[text_col].alias("__text")), benchmark, window, "__row", "__text", unnamed=unnamed)
    return found.filter(F.size("spans") == 0).select("__row.*")
