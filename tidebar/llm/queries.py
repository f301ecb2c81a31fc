"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_tokenizer, decontamination, html_extraction, near_dedup, packing, permutation_index, pii, secret_scan, token_counts, token_store, toxicity, url_filter, whitening
from .common import table, workdir


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, unnamed=True)
    n_hit = decontamination.hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest",
    )


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workdir(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2, folder=folder)
    return token_store.read_digests(spark, folder)


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


URL_RULES = [url_filter.Rule.of(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), max_tokens=4096)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(table(spark, sf_dir, "pages"))


def fold(id_column: str = "id"):
    """Remainder of the CRC-32 of an id's text modulo 5; rows of fold 0 are held out."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fit_table(docs, table(spark, sf_dir, "labels"), train=fold() != 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pii_key(spark: SparkSession) -> DataFrame | str:
    """The secret of the pseudonyms: the only line of the text file that the session names; the open one in its place is for test data only."""
    path = spark.conf.get("spark.tidebar.pii.keyfile", None)
    return spark.read.text(path) if path else "forTestDataOnly"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark), found_col="found")
    per_kind = [F.expr(f"size(filter(found, x -> x.kind = '{kind}'))").alias(f"n_{kind}") for kind in pii.KINDS]
    return out.select("doc_id", "text", F.size("found").alias("n_found"), *per_kind)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), similarity=(85, 100))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))[0]


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner, a document a repository."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"), owner_col="source", repository_col="doc_id")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_store": op2_token_store,
    "op3_permutation_index": op3_permutation_index,
    "op4_packing": op4_packing,
    "op5_url_filter": op5_url_filter,
    "op6_token_counts": op6_token_counts,
    "op7_html_extraction": op7_html_extraction,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_near_dedup": op10_near_dedup,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_secret_scan": op12_secret_scan,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op5_url_filter": url_filter.duckdb_sql(URL_RULES),
}
