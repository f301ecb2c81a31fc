"""A content-addressed store of token ids.

Layout under one folder, all Parquet:

* ``store/kind=chunk``: key (SHA-256 of the width of an id and the ids), n, payload (ids,
  little-endian, 2 or 4 bytes). A rolling hash over the last 16 ids decides where documents are
  cut into chunks, so equal passages give equal chunks wherever they stand, and each different
  chunk is stored once.
* ``store/kind=recipe``: key (Merkle root over each chunk's key and the number of ids behind it),
  n, these keys and numbers in order; equal documents share one recipe.
* ``manifest``: one row a document in ascending id order, over range-partitioned files: recipe
  root, number of ids, place in the file and the ids before it there.
* ``tree``: for each file of the manifest the Merkle root over its rows, its ids and the ids of
  all files before it; ``root``: one digest over the rows of ``tree``, which fixes the whole store.

Every read begins with the store's root, the tree and the manifest; each recipe is checked
against its root, each chunk against its key and each document's number of ids against its
chunks. A missing or changed piece stops the read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize, sliced
from .tokens import encoder, with_end

WINDOW = 16
MIN_CHUNK, MAX_CHUNK = 64, 8192
#: A cut where these bits of the rolling hash are 0: chunks of 1024 ids above the least, on average.
CUT_MASK = np.uint64(0x3FF << 20)
#: Keys a task remembers so as not to send a chunk twice.
SEEN = 400_000

_ENTRY = "kind string, slot int, key binary, doc_id long, n long, keys array<binary>, behind array<long>, payload binary"


def _gear() -> np.ndarray:
    """A fixed random 64-bit value for each of 65,536 residues of an id."""
    x = np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def rolling_cuts(ids: np.ndarray) -> np.ndarray:
    """Positions behind which a chunk may end: the hash of the 16 ids up to there has its mask bits 0."""
    h = _gear()[ids & 0xFFFF]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
    return np.flatnonzero((h & CUT_MASK) == 0) + 1


def chunk_ends(cuts: np.ndarray, n: int) -> list[int]:
    """Chunk ends of a document of n ids, given its possible cuts: chunks from MIN_CHUNK to MAX_CHUNK, the last may be shorter."""
    ends, at = [], 0
    for c in cuts.tolist():
        while c - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if c - at >= MIN_CHUNK and c < n:
            at = c
            ends.append(at)
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    return [*ends, n]


def chunk_key(payload: bytes, n: int) -> bytes:
    return hashlib.sha256(bytes([len(payload) // n]) + payload).digest()


def merkle_root(keys: list[bytes], behind: list[int]) -> bytes:
    """Root of a binary Merkle tree over (key, ids behind); leaves and inner nodes are hashed apart, a lone node moves up."""
    level = [hashlib.sha256(b"\0" + k + n.to_bytes(8, "little")).digest() for k, n in zip(keys, behind, strict=True)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = encoder(tokenizer), set()
        width = "<u2" if max(words.library.get_vocab_size(with_added_tokens=True), end_id + 1) <= 0x10000 else "<u4"
        for batch, texts in sliced(batches, "text"):
            ids, counts = with_end(*words.encode(texts), end_id)
            cuts, upto = rolling_cuts(ids), np.cumsum(counts)
            rows: list[tuple] = []
            if len(seen) > SEEN:
                seen.clear()
            # a cut nearer than WINDOW to a document's start would see the document before it
            bounds = np.searchsorted(cuts, np.stack([upto - counts + WINDOW, upto]))
            for i, (doc, end, n) in enumerate(zip(batch.column(0).to_pylist(), upto.tolist(), counts.tolist())):
                start = end - n
                ends = chunk_ends(cuts[bounds[0, i] : bounds[1, i]] - start, n)
                keys = []
                for a, b in zip([0, *ends], ends):
                    payload = ids[start + a : start + b].astype(width).tobytes()
                    key = chunk_key(payload, b - a)
                    keys.append(key)
                    if key not in seen:
                        seen.add(key)
                        rows.append(("chunk", int.from_bytes(key[:4], "big") & 0x7FFFFFFF, key, None, b - a, None, None, payload))
                behind = [n - e for e in ends]
                root = merkle_root(keys, behind)
                rows.append(("doc", int.from_bytes(root[4:8], "big") & 0x7FFFFFFF ^ (doc or 0) & 0x7FFFFFFF, root, doc, n, None, None, None))
                if root not in seen:
                    seen.add(root)
                    rows.append(("recipe", int.from_bytes(root[:4], "big") & 0x7FFFFFFF, root, None, n, keys, behind, None))
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), _ARROW)], schema=pa.schema(list(zip(_NAMES, _ARROW))))

    return run


_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]
_ARROW = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]


def write_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write the store to ``folder``.

    ``id_col`` must hold integers. Null texts count as empty and keep their end id; rows that
    repeat each get a manifest row; null ids come first. Other columns are not read. An empty
    table gives an empty store.

    One shuffle: chunks and recipes meet by key, each sent at most once by a task, so thousands
    of copies of a document send one copy of its chunks a task; document rows are spread.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_encode(tokenizer, end_id), _ENTRY)
    once = F.when(F.col("kind") == "doc", 1).otherwise(F.row_number().over(Window.partitionBy("slot", "kind", "key").orderBy("n")))
    (rows.repartition("slot").withColumn("turn", once).filter("turn = 1").drop("turn", "slot")
         .write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/store"))
    listed = _read(spark, folder, "doc").select("doc_id", F.col("key").alias("root"), "n")
    listed = listed.repartitionByRange(F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    manifest = materialize(listed.mapInArrow(_placed, "doc_id long, root binary, n long, file int, place long, before long"), f"{folder}/manifest")
    # one row a file: few, whatever the number of documents
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tree = materialize(_file_roots(manifest).select("file", "node", "n", before.alias("offset")), f"{folder}/tree")
    materialize(_store_root(tree), f"{folder}/root")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the documents of a sorted range partition, with the ids before each in that partition."""
    from pyspark import TaskContext

    part, place, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column(2).to_numpy()
        upto = np.cumsum(n) + before
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(place, place + len(n))), pa.array(upto - n)],
            names=["doc_id", "root", "n", "file", "place", "before"],
        )
        if len(n):
            place, before = place + len(n), int(upto[-1])


def _file_roots(manifest: DataFrame, fan: int = 1024) -> DataFrame:
    """file, node, n: Merkle root and ids of each file of the manifest; nodes over ``fan`` documents each, then a root over these."""

    def over(df: DataFrame, *by) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("place", "node")))
        return df.groupBy(*by).agg(F.sha2(F.concat_ws("", F.transform(ordered, lambda x: x["node"])), 256).alias("node"), F.sum("n").alias("n"))

    said = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.hex("root"), *[F.col(c).cast("string") for c in ("n", "place", "before")])
    leaves = manifest.select("file", "place", F.sha2(said, 256).alias("node"), "n")
    nodes = over(leaves.withColumn("block", F.floor(F.col("place") / fan)), "file", "block")
    return over(nodes.withColumnRenamed("block", "place"), "file")


def _store_root(tree: DataFrame) -> DataFrame:
    """root: one digest over the rows of all files in order."""
    rows = F.array_sort(F.collect_list(F.struct("file", "node", "n", "offset")))
    return tree.agg(F.sha2(F.to_json(rows), 256).alias("root"))


def _read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    schema = "key binary, doc_id long, n long, keys array<binary>, behind array<long>, payload binary, kind string"
    return spark.read.schema(schema).parquet(f"{folder}/store").filter(F.col("kind") == kind)


def verify_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the manifest whose Merkle root is not the one in the tree; none if all is well."""
    manifest, tree = spark.read.parquet(f"{folder}/manifest"), spark.read.parquet(f"{folder}/tree")
    return _file_roots(manifest).select("file", F.col("node").alias("now")).join(tree, "file", "full_outer").filter("not (now <=> node)")


def _sound(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with the offset of its file, after root, tree and manifest have been checked."""
    tree = spark.read.parquet(f"{folder}/tree")
    if _store_root(tree).first() != spark.read.parquet(f"{folder}/root").first():
        raise ValueError("the tree does not match the root of the store")
    if not verify_manifest(spark, folder).isEmpty():
        raise ValueError("the manifest does not match its tree")
    return spark.read.parquet(f"{folder}/manifest").join(tree.select("file", "offset"), "file")


def _entries(spark: SparkSession, folder: str, chunks: DataFrame) -> DataFrame:
    """Chunks of the recipes: root, behind, and the columns of ``chunks``; a chunk that many recipes share is dealt over tasks."""
    recipes = _read(spark, folder, "recipe").select("key", "keys", "behind")
    shared = recipes.select(F.explode("keys").alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
    entries = recipes.mapInArrow(_recipe_entries, "root binary, chunk binary, behind long")
    return join_hot(entries, chunks, ["chunk"], "root", counts=shared)


def _chunk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for key, n, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk_key(payload, n) != key:
                raise ValueError(f"chunk {key.hex()} does not match its key")
            crcs.append(zlib.crc32(np.frombuffer(payload, f"<u{len(payload) // n}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["chunk", "m", "crc"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, n, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk_key(payload, n) != key:
                raise ValueError(f"chunk {key.hex()} does not match its key")
        yield pa.RecordBatch.from_arrays(batch.columns, names=["chunk", "n", "payload"])


def _recipe_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for root, keys, behind in zip(*(c.to_pylist() for c in batch.columns)):
            if merkle_root(keys, behind) != root:
                raise ValueError(f"recipe {root.hex()} does not match its root")
            rows += [(root, k, b) for k, b in zip(keys, behind)]
        root, chunk, behind = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(root, pa.binary()), pa.array(chunk, pa.binary()), pa.array(behind, pa.int64())], names=["root", "chunk", "behind"])


_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reflected 32-bit polynomials modulo the CRC-32 polynomial."""
    b, out = b.copy(), np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ _POLY, b >> np.uint64(1))
    return out


def crc_followed_by(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to the CRC-32 of a longer string in which ``n_bytes`` bytes follow; xor of such parts is the whole's."""
    out, power = crc.astype(np.uint64), np.full(1, 1 << 23, np.uint64)
    left = n_bytes.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _times(out[odd], np.repeat(power, int(odd.sum())))
        left, power = left >> np.uint64(1), _times(power, power)
    return out


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        root, behind, m, crc = batch.columns
        part = crc_followed_by(crc.to_numpy(), behind.to_numpy() * 4)
        yield pa.RecordBatch.from_arrays([root, m, pa.array(part.astype(np.int64))], names=["root", "m", "part"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Every stored chunk is read and checked against its key once. Its CRC-32 over 32-bit ids then
    stands for it: the CRC-32 of a document is the xor of its chunks' CRCs, each moved by the
    ids that follow it. So copies cost no second read, and no whole document is gathered.
    """
    chunks = _read(spark, folder, "chunk").select("key", "n", "payload").mapInArrow(_chunk_digests, "chunk binary, m long, crc long")
    whole = _entries(spark, folder, chunks).select("root", "behind", "m", "crc").mapInArrow(_moved, "root binary, m long, part long")
    whole = whole.groupBy("root").agg(F.bit_xor("part").alias("ids_crc32"), F.sum("m").alias("m"))
    sound = F.when(F.col("m") == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("a document's chunks are missing")).cast("long"))
    read = join_hot(_sound(spark, folder), whole, ["root"], "doc_id", "left")
    return read.select("doc_id", (F.col("offset") + F.col("before")).alias("start"), sound.alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids (array<int>) of every document, put together from the store."""
    chunks = _read(spark, folder, "chunk").select("key", "n", "payload").mapInArrow(_checked, "chunk binary, n long, payload binary")
    parts = _entries(spark, folder, chunks).groupBy("root").agg(F.sort_array(F.collect_list(F.struct(-F.col("behind"), "n", "payload"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(p["payload"], f"<u{len(p['payload']) // p['n']}").astype(np.int32) for p in x]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    whole = F.coalesce(F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"]) == F.col("n"), F.lit(False))
    sound = F.when(whole, F.col("parts")).otherwise(F.raise_error(F.lit("a document's chunks are missing")))
    return _sound(spark, folder).join(parts, "root", "left").select("doc_id", sound.alias("parts")).mapInArrow(joined, "doc_id long, ids array<int>")
