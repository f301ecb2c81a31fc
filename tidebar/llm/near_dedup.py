"""Near-duplicate classes: fast similarity sketches, banding, exact verification of every bucket.

1. A task makes a document's shingle set, its 128-bit digest and its sketch. Documents of equal
   digest are exact copies: each digest goes on once, so groups of copies cost one. Digests stand
   for texts up to the links; only those are named by ids, as one id may have several texts.
2. The sketch is cut into bands; sets that agree in a band share a bucket. With 24 bands of 4
   bins, a pair at a similarity of 0.85 shares none with a probability of 2e-8, at 0.8 of 3e-6.
   Buckets with the same members are kept once.
3. Every kept bucket is verified whole. Its members are dealt into blocks of a bounded size; the
   member whose digest has the least hash stands in every block. A task counts all intersections of the full
   shingle sets of a block by one matrix product and returns the links that join what isn't joined
   yet, fewer than its members, and the members that its links don't join to the least one. Only
   those can still tell classes apart or join them, so only they are held, by blocks again,
   against all other blocks of the bucket. So a group of near copies costs one pass however large
   it is, no bucket is too large for a task, no link that joins texts is lost and pairs are never
   listed.
4. Links give connected components by label propagation over tables in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, discard, hot_keys, join_hot, let_go, materialize, repeated, sliced, workdir
from .sketching import shingle_sets, sketches

ROWS, BANDS = 4, 24
#: Members and shingles of a bucket that one block holds, on average, at most.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000

_SKETCH = "doc_id long, key long, n_shingles long, digest binary, bands array<long>"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch, texts in sliced(batches, "text"):
        value, doc = shingle_sets(texts)
        table = sketches(value, doc, len(texts), ROWS * BANDS).reshape(len(texts), BANDS, ROWS)
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        size = np.diff(bounds)
        bands = []
        digests = []
        for i, n in enumerate(size.tolist()):
            if not n:
                bands.append(None)
                digests.append(None)
                continue
            digests.append(hashlib.blake2b(value[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest())
            bands.append([int.from_bytes(hashlib.blake2b(bytes([j]) + table[i, j].tobytes(), digest_size=8).digest(), "little", signed=True) for j in range(BANDS)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "digest", "bands"])


class Classes:
    """Members joined so far, each class by its least member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _verified(threshold: tuple[int, int], first: bool):
    """Links (a, b) of a block: of all pairs with num * union <= den * intersection, those that join classes.

    In the first pass, rows (member, null) are the members not joined to the bucket's least one;
    in the second, only pairs of a member ``left`` over and another one are held together.
    """
    num, den = threshold

    def run(key: tuple, table: pa.Table) -> pa.Table:
        row = {d: i for i, d in enumerate(table.column("digest").to_pylist())}  # the least member, or one left over, may stand twice
        node = sorted(row)
        texts = [table.column("text")[row[d]].as_py() or "" for d in node]
        over = set() if first else {d for d, left in zip(table.column("digest").to_pylist(), table.column("left").to_pylist()) if left}
        value, doc = shingle_sets(texts)
        del texts
        size = np.bincount(doc, minlength=len(node))
        _, column, often = np.unique(value, return_inverse=True, return_counts=True)
        classes, links = Classes(len(node)), []
        if len(node) > 1:
            shared = often[column] > 1
            doc, column = doc[shared], np.unique(column[shared], return_inverse=True)[1]
            common = _intersections(doc, column, len(node))
            asked = np.array([first or d in over for d in node])
            for i in range(len(node)):
                both = common[i, :i]
                # intersection / union >= num / den, in whole numbers
                near = (den * both >= num * (size[i] + size[:i] - both)) & (both > 0) & (asked[i] | asked[:i])
                links += [(node[i], node[j]) for j in np.flatnonzero(near).tolist() if classes.join(i, j)]
        if first and table.column("blocks")[0].as_py() > 1:
            least = {classes.root(node.index(d)) for d, x in zip(table.column("digest").to_pylist(), table.column("least").to_pylist()) if x}
            links += [(d, None) for i, d in enumerate(node) if classes.root(i) != min(least)]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(a), pa.int64()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _intersections(doc: np.ndarray, column: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of n sets, by products of 0/1 matrices of ``width`` columns at a time."""
    out = np.zeros((n, n), np.float32)
    by = np.argsort(column, kind="stable")
    doc, column = doc[by], column[by]
    edges = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + 1 + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a < b:
            part = np.zeros((n, width), np.float32)
            part[doc[a:b], column[a:b] - k * width] = 1
            out += part @ part.T
    return out.astype(np.int64)


def connected(links: DataFrame, folder: str) -> DataFrame:
    """node, component (the least node reachable) for the nodes of links (a, b).

    Each round, every node takes the least label among its own and its neighbours', and then the
    label of that label; rounds end when no label changes. Tables of each round stand in the
    shared folder, two at a time matter. Hubs of many links are dealt over several tasks.
    """
    both = links.union(links.select("b", "a")).distinct()
    both = materialize(both.select("a", F.col("b").alias("node")), f"{folder}/both")
    hot = hot_keys(both.groupBy("node").agg(F.count("*").alias("n")), ["node"])
    edges = materialize(dealt(both, hot, ["node"], "a"), f"{folder}/edges")
    labels = materialize(edges.groupBy("a").agg(F.min("node").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), f"{folder}/labels-0")
    for k in count(1):
        near = edges.join(repeated(labels, hot, ["node"]), ["node", "__salt"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("component").alias("up"))
        moved = materialize(join_hot(step, up, ["new"], "node", "left").select("node", "old", F.least("new", F.coalesce("up", "new")).alias("component")), f"{folder}/labels-{k}")
        labels = moved.select("node", "component")
        if k > 1:
            discard(links.sparkSession, f"{folder}/labels-{k - 2}")
        if moved.filter("old <> component").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (85, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents whose sets of five-word shingles have a Jaccard similarity of at least
    ``similarity`` (a fraction of whole numbers) are linked; component_id is the least id that
    links reach, and kept marks the row of that id. Null and empty texts have no shingles, are
    linked with nothing and kept. Rows that share an id count as one document with all their
    texts. Rows without an id can't be named: they are kept as they are, with a null component.
    Other columns are not read; an empty table gives no rows.
    """
    spark, folder = docs.sparkSession, workdir(docs.sparkSession)
    whole = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    rows = materialize(whole.mapInArrow(_sketched, _SKETCH), f"{folder}/sketches")
    named = rows.filter("doc_id is not null and digest is not null")
    same = named.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.min_by("bands", "doc_id").alias("bands"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    same = materialize(same.select("digest", F.col("first.doc_id").alias("node"), F.col("first.key").alias("key"), "bands", "n_shingles", "n"), f"{folder}/same")
    entries = materialize(same.select("digest", "n_shingles", F.explode("bands").alias("bucket")), f"{folder}/entries")
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.min(F.xxhash64("digest")).alias("least"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(7))).alias("y")).filter("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    kept = buckets.groupBy("n", "least", "x", "y").agg(F.min("bucket").alias("bucket"), F.max("shingles").alias("shingles")).select("bucket", "least", "n", blocks)
    kept = materialize(kept, f"{folder}/buckets")
    inside = materialize(join_hot(entries.select("bucket", "digest"), kept, ["bucket"], "digest", counts=kept).select("bucket", "digest", "least", "blocks"), f"{folder}/inside")
    # the texts of candidates, by a merge join at every size: the ids grow with the corpus; the key tells texts of one id apart
    wanted = same.join(inside.select("digest").distinct(), "digest", "left_semi").select("digest", F.col("node").alias("doc_id"), "key")
    # (rows that repeat meet there, and one text a digest goes on)
    found = whole.join(wanted.hint("merge"), ["doc_id", "key"]).groupBy("doc_id", "key", "digest").agg(F.first("text").alias("text"))
    texts = materialize(found.select("digest", "text"), f"{folder}/texts")
    placed = inside.withColumn("least", F.xxhash64("digest") == F.col("least")).withColumn("block", F.when(F.col("least"), -1).otherwise(F.pmod(F.xxhash64("digest", F.lit(11)), F.col("blocks"))).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    once = placed.withColumn("block", F.explode(F.when(F.col("block") < 0, every).otherwise(F.array("block"))))
    near = once.join(texts, "digest").groupBy("bucket", "block").applyInArrow(_verified(similarity, True), "bucket long, a binary, b binary")
    near = materialize(near, f"{folder}/near")
    # what a block didn't join to its bucket's least member meets all other blocks, in blocks of its own
    left = near.filter("b is null").select("bucket", F.col("a").alias("digest"))
    rest = left.groupBy("bucket").agg(F.count("*").alias("m")).join(kept, "bucket").select("bucket", "blocks", F.ceil(F.col("m") * F.col("blocks") / F.col("n")).cast("int").alias("parts"))
    rest = materialize(rest, f"{folder}/rest")
    over = join_hot(left, rest, ["bucket"], "digest").withColumn("part", F.pmod(F.xxhash64("digest", F.lit(13)), F.col("parts")).cast("int"))
    over = over.select("bucket", "digest", "part", F.explode(every).alias("block"), F.lit(True).alias("left"))
    others = join_hot(placed.filter("blocks > 1").select("bucket", "digest", "block"), rest, ["bucket"], "digest", counts=kept).withColumn("block", F.greatest("block", F.lit(0)))
    others = others.select("bucket", "digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", F.lit(False).alias("left"))
    later = over.unionByName(others).join(texts, "digest").groupBy("bucket", "part", "block").applyInArrow(_verified(similarity, False), "bucket long, a binary, b binary")
    near = near.filter("b is not null").unionByName(materialize(later, f"{folder}/later")).select("a", "b")
    name = lambda c, to: same.select(F.col("digest").alias(c), F.col("node").alias(to))
    links = join_hot(join_hot(near, name("a", "na"), ["a"], "b"), name("b", "nb"), ["b"], "a").filter("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    # the sets of rows that share an id are linked, as they are one document's
    copies = join_hot(named.select("doc_id", "digest"), same.select("digest", "node"), ["digest"], "doc_id", counts=same).select("doc_id", "node")
    several = copies.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a <> last")
    own = copies.join(several, "doc_id").filter("a <> node").select("a", F.col("node").alias("b"))
    linked = connected(materialize(links.union(own), f"{folder}/links"), folder)
    groups = materialize(same.select("digest", "node", "n").join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("component"), "n"), f"{folder}/groups")
    out = join_hot(rows.select("doc_id", "n_shingles", "digest"), groups.drop("n"), ["digest"], "doc_id", "left", counts=groups)
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, without near copies of a row of a lesser id.

    Rows that share an id stay or go together; rows without an id stay.
    """
    kept = near_duplicates(docs, similarity, id_col, text_col).filter("kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    named = docs.join(kept.hint("merge"), id_col, "left_semi").select(*[f"`{c}`" for c in docs.columns])
    return named.unionAll(docs.filter(docs[id_col].isNull()))
