"""What a worker keeps of words is bounded, whatever it has read."""

import random

import public_tokenizers
import pyarrow as pa
import pyspark

from tidebar.llm import common
from tidebar.llm import cross_tokenizer as X

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _documents(blocks) -> list[tuple]:
    return [r for b in blocks for r in zip(*[b.column(c)[0].as_py() for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "shas")])]


def test_words_kept_are_bounded(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("etaoinsh", k=7)) for _ in range(50)) for _ in range(60)]
    batches = [pa.record_batch([pa.array(range(i, i + 5), pa.int64()), pa.array(texts[i : i + 5])], names=["id", "text"]) for i in range(0, 60, 5)]

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    common.let_go()
    whole = list(X._blocks(*PATHS, "end")(iter(batches)))
    common.let_go()
    kept, clear = [], X.Aligner.clear
    monkeypatch.setattr(X.Aligner, "clear", lambda self: (kept.append(len(getattr(self, "text", []))), clear(self))[1])
    monkeypatch.setattr(X, "WORDS_LEARNT", 40)
    parts = list(X._blocks(*PATHS, "end", limit=600)(iter(batches)))
    common.let_go()
    assert _documents(parts) == _documents(whole)
    assert len(whole) == 1 and len(parts) > 3
    assert max(kept) <= 600 + 250  # the limit and a slice


def test_files_hold_few_blocks(spark, monkeypatch):
    """A task writes and reads its blocks, of megabytes each, a few at a time, however many it makes."""
    texts = [f"some words of document {n}, and more of them" for n in range(60)]
    monkeypatch.setattr(X, "BLOCK_BYTES", 100)  # less than a slice, which is three documents
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    folders, write = [], X.materialize
    monkeypatch.setattr(X, "materialize", lambda df, path, *rows: (folders.append(path), write(df, path, *rows))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out, _ = X.align(docs, *PATHS)
    per_file = [r["count"] for r in spark.read.parquet(folders[0]).groupBy("_metadata.file_path").count().collect()]
    assert sum(per_file) == 20 and max(per_file) <= X.BLOCKS_A_FILE
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.doc_id for r in out.filter("n_links > 0").collect()) == list(range(60))
