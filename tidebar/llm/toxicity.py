"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, each hashed to a row of an embedding
table; misspellings never met in training share most of their rows with the word. A document is
the average of the vectors of all subwords of all its words, and a linear softmax on it gives
the probability of each class. Embeddings and softmax are trained together, by Adam on whole
documents of a sample of at most ``SAMPLE`` labelled rows of each class.

The model is linear in the average, so a subword counts by one number: the difference of its two
class logits. Scoring sums these numbers by word, and keeps them for words met again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, sliced
from .sketching import _STEP, _power_tables, mix

#: Labelled rows of each class that a model is fitted on, at most; a sample by hash of the id.
SAMPLE = 2000
#: Characters of the texts of a class in that sample, at most.
SAMPLE_CHARS = 20_000_000
BUCKETS, DIM = 1 << 17, 4
SHORTEST, LONGEST = 3, 5
#: The average of many subwords is small; this brings it to the scale of a logit.
SCALE = 64.0

_OPEN, _CLOSE = 0x110000, 0x110001
_CHAR = mix(np.arange(1, 0x110003, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_FACTOR = np.array([pow(_BASE, k, 1 << 64) for k in range(64)], np.uint64)


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for code in range(0x110000):
        table[code] = chr(code).isalnum()
    return table


class Words:
    """The words (runs of letters and digits, lower-cased) of a slice of texts: hash, place and text number of each."""

    letters: np.ndarray | None = None

    def __init__(self, texts: list[str]):
        if Words.letters is None:
            Words.letters = _letters()
        parts = [t.lower() for t in texts]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.code = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = Words.letters[self.code]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.text = np.searchsorted(np.cumsum(size), self.start, side="right")
        # a word's polynomial hash is a difference of two prefix sums, however long the word
        power, inverse = _power_tables(len(self.code))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CHAR[self.code] * power[: len(self.code)], dtype=np.uint64)])
        self.hash = mix((upto[self.end] - upto[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64) * _STEP)

    def subwords(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, number of the word in ``chosen``) of the subwords of the chosen words."""
        length = self.end[chosen] - self.start[chosen]
        framed = length + 2
        begin = np.cumsum(framed) - framed
        word = np.repeat(np.arange(len(chosen)), framed)
        inner = np.arange(int(framed.sum())) - begin[word]
        code = np.where(inner == 0, _OPEN, np.where(inner == framed[word] - 1, _CLOSE, self.code[np.minimum(self.start[chosen][word] + np.maximum(inner - 1, 0), len(self.code) - 1)]))
        value = np.append(_CHAR[code], np.zeros(LONGEST, np.uint64))
        h = np.zeros(len(code), np.uint64)
        found = [(mix(self.hash[chosen]), np.arange(len(chosen)))]
        for k in range(LONGEST):
            h = h + value[k : k + len(code)] * _FACTOR[k]
            if k + 1 >= SHORTEST:
                whole = inner + k + 1 <= framed[word]
                found.append((mix(h[whole] + np.uint64(k)), word[whole]))
        return (np.concatenate([x for x, _ in found]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([w for _, w in found])


def _times(to: np.ndarray, by: np.ndarray, values: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of the columns ``by`` of ``values`` (dim, any), times weight, into columns ``to`` of (dim, n)."""
    return np.stack([np.bincount(to, v[by] if weight is None else v[by] * weight, n) for v in values])


@dataclass
class Model:
    """logit: of each subword bucket, times SCALE; bias: the class bias. score = sigmoid(mean logit + bias)."""

    logit: np.ndarray
    bias: float
    limit: int = 400_000
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    value: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))

    def scores(self, texts: list[str]) -> np.ndarray:
        words = Words(texts)
        distinct, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(self.known) + len(new) > self.limit:
            self.known, self.value, new = np.zeros(0, np.uint64), np.zeros((2, 0)), np.arange(len(distinct))
        if len(new):
            bucket, word = words.subwords(first[new])
            value = np.stack([np.bincount(word, self.logit[bucket], len(new)), np.bincount(word, minlength=len(new))])
            known = np.concatenate([self.known, distinct[new]])
            by = np.argsort(known)
            self.known, self.value = known[by], np.concatenate([self.value, value], axis=1)[:, by]
        total, n = self.value[:, np.searchsorted(self.known, distinct)][:, back]
        total, n = (np.bincount(words.text, x, len(texts)) for x in (total, n))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -60, 60)))


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, rounds: int = 70, rate: float = 0.2, decay: float = 1e-5, seed: int = 1, least_texts: int = 2) -> Model:
    """Train embeddings and softmax on whole texts, weighted, by Adam over the full sample.

    Words that stand in fewer than ``least_texts`` of the training texts count in the average of their text, but train no
    vectors of their own; scores use the subwords of all words. With 1, every word trains.
    """
    if not len(texts) or toxic.min() == toxic.max():
        share = float(np.average(toxic, weights=weight)) if len(texts) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    slices = [range(i, min(i + 200, len(texts))) for i in range(0, len(texts), 200)]
    seen = []
    for part in slices:
        words = Words([texts[i] for i in part])
        order = np.lexsort((words.hash, words.text))
        h, t = words.hash[order], words.text[order]
        seen.append(h[np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]])
    common, often = np.unique(np.concatenate(seen), return_counts=True)
    common = common[often >= least_texts]
    del seen, often
    filled, size = np.zeros(len(common), bool), np.ones(len(texts))
    rows, columns, counts, buckets, owners = [], [], [], [], []
    for part in slices:
        words = Words([texts[i] for i in part])
        distinct, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        bucket, word = words.subwords(first)
        size[part.start : part.stop] = np.maximum(np.bincount(words.text, np.bincount(word, minlength=len(distinct))[back], len(part)), 1)
        number = np.searchsorted(common, distinct)
        known = common[np.minimum(number, len(common) - 1)] == distinct if len(common) else np.zeros(len(distinct), bool)
        new = known.copy()
        new[known] = ~filled[number[known]]
        filled[number[new]] = True
        buckets.append(bucket[new[word]].astype(np.int32))
        owners.append(number[word[new[word]]].astype(np.int32))
        live = known[back]
        pair, n = np.unique(words.text[live] * max(len(common), 1) + number[back[live]], return_counts=True)
        rows.append((pair // max(len(common), 1) + part.start).astype(np.int32))
        columns.append((pair % max(len(common), 1)).astype(np.int32))
        counts.append(n)
    owner = np.concatenate(owners)
    used, bucket = np.unique(np.concatenate(buckets), return_inverse=True)
    row, column, share = np.concatenate(rows), np.concatenate(columns), np.concatenate(counts)
    share = share / size[row] * SCALE
    n_words, n_texts = len(common), len(texts)
    del owners, buckets, rows, columns, counts, common, filled, words
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.01, (DIM, len(used))), rng.normal(0, 1, (2, DIM)), np.zeros((2, 1))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    target = np.stack([1 - toxic, toxic])
    weight = weight / weight.sum()
    for step in range(1, rounds + 1):
        embeddings, softmax, bias = params
        mean = _times(row, column, _times(owner, bucket, embeddings, n_words), n_texts, share)
        z = softmax @ mean + bias
        p = np.exp(z - z.max(axis=0))
        off = (p / p.sum(axis=0) - target) * weight
        back = _times(bucket, owner, _times(column, row, softmax.T @ off, n_words, share), len(used))
        grads = [back + decay * embeddings, off @ mean.T + decay * softmax, off.sum(axis=1, keepdims=True)]
        for p_, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    embeddings, softmax, bias = params
    logit = np.zeros(BUCKETS, np.float32)
    logit[used] = SCALE * ((softmax[1] - softmax[0]) @ embeddings)
    return Model(logit, float(bias[1, 0] - bias[0, 0]))


def labelled_sample(docs: DataFrame, wanted: DataFrame, sample: int, chars: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """toxic, place, text: of each class of ``wanted`` (id, toxic), at most ``sample`` rows and ``chars`` characters, by the hash of the id."""
    picked = [wanted.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    picked = picked[0].union(picked[1])  # at most 2 * sample ids
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).filter(F.length("text") <= chars)
    once = texts.join(F.broadcast(picked), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")
    rows = once.withColumn("so_far", F.sum(F.length("text")).over(order)).withColumn("place", F.row_number().over(order))
    return rows.filter(F.col("so_far") <= chars).select("toxic", "place", "text")


def _trained(counts: dict[int, int]):
    """One row, the model, from the labelled sample, whose size is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        rows = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        toxic = np.array([r[0] for r in rows], np.float32)
        have = np.bincount(toxic.astype(int), minlength=2)
        weight = np.array([counts[int(t)] / have[int(t)] for t in toxic], np.float64)
        model = fit([r[2] for r in rows], toxic, weight)
        del rows
        let_go()
        yield pa.RecordBatch.from_arrays([pa.array([model.logit.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], names=["logit", "bias"])

    return run


def fit_table(docs: DataFrame, labels: DataFrame, train: Column | None = None, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` labelled rows of each class: those of least hash of the id.

    ``train`` is a condition on ``id``; rows that don't meet it are never seen. The two classes
    are weighted to the shares they have among all labelled rows. Rows with a null id or label,
    or without a text row, are not used; of several texts of an id the least one is; an id that
    is labelled both ways counts as toxic. Texts of a class come as long as they have at most
    ``chars`` characters together, so what the training task gets is bounded; the driver gets
    the model alone.
    """
    wanted = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    wanted = wanted.groupBy("id").agg(F.max("toxic").alias("toxic"))
    if train is not None:
        wanted = wanted.filter(train)
    counts = {r["toxic"]: r["n"] for r in wanted.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = labelled_sample(docs, wanted, sample, chars, text_col, id_col).repartition(1)
    found = rows.mapInArrow(_trained(counts), "logit binary, bias double").first()
    return fit([], np.zeros(0), np.zeros(0)) if found is None else Model(np.frombuffer(found["logit"], "<f4"), found["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` read by name ``id_col``: id and score (0 to 1) of every whole text.

    Null and empty texts get the score of no words (the bias alone). Rows that repeat are each scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.logit, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        model = Model(*shared.value)
        for batch, texts in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose whole text scores below ``threshold``.

    Null and empty texts score by the softmax's bias alone, as text without words; rows that repeat stay or go together;
    null ids and other columns play no part; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.logit, model.bias))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        model = Model(*shared.value)
        names = None
        for batch in batches:
            names = names or batch.schema.names
            for part, texts in sliced([batch], names[at]):
                yield part.filter(pa.array(model.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
