"""Streams whose rows may come again at any time later: an archive, a Bloom filter a day, and an exact look only at what may be known.

The stream itself remembers nothing. Each micro-batch asks the filters of its rows' days, some bits a row; only rows whose bits
are all set are held against the archive of these days. What is new is written as the batch's part of the archive, and its
bits as the batch's part of the filters; a batch that runs again replaces its own parts and doesn't see them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

#: Bits of a day's filter in all, in one bitmap, and set by a row. Of new rows, 1.3 % look known after a million rows a day, 4.5 % after two million.
BITS, BITMAP, HASHES = 2**24, 32_768, 2


def _bits(keys: list[str]) -> Column:
    """The places of a row's bits."""
    places = [F.pmod(F.xxhash64(*keys, F.lit(k)), F.lit(BITS)) for k in range(HASHES)]
    return F.array(*[F.struct(F.floor(p / BITMAP).cast("int").alias("bitmap"), (p % BITMAP).cast("int").alias("place")) for p in places])


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2 == 1


def maybe_known(rows: DataFrame, filters: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (with ``day``) whose bits are all set in ``filters`` (day, bitmap, bits): all known ones, and few others."""
    asked = rows.withColumn("_bit", F.explode(_bits(keys))).select(*keys, "day", F.col("_bit.bitmap").alias("bitmap"), F.col("_bit.place").alias("place"))
    found = asked.join(filters.select("day", "bitmap", "bits"), ["day", "bitmap"]).filter(_is_set(F.col("bits"), F.col("place")))
    hits = found.groupBy(*keys, "day").agg(F.size(F.collect_set(F.struct("bitmap", "place"))).alias("_hits"))
    own = F.size(F.array_distinct(_bits(keys)))
    return hits.filter(F.col("_hits") == own).select(*keys, "day")


def filters_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """day, bitmap, bits of the rows."""
    bit = rows.withColumn("_bit", F.explode(_bits(keys)))
    return bit.groupBy("day", F.col("_bit.bitmap").alias("bitmap")).agg(F.bitmap_construct_agg(F.col("_bit.place").cast("long")).alias("bits"))


def archive_once(stream: DataFrame, keys: list[str], ts: str, folder: str) -> DataStreamWriter:
    """A writer that archives the first of rows with equal ``keys``, however late the others come; ``keys`` determine ``ts``.

    The archive is ``<folder>/rows``, with the columns of the stream, ``day`` and ``batch``. Keys must not be null.
    """
    rows_at, bits_at = f"{folder}/rows", f"{folder}/filters"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("day", F.to_date(ts)).dropDuplicates(keys)
        if number > 0:  # batches are numbered from 0 for the life of the checkpoint
            filters = spark.read.schema("day date, bitmap int, bits binary, batch long").parquet(bits_at).filter(F.col("batch") < number)
            archive = spark.read.schema(f"{', '.join(f'{k} {batch.schema[k].dataType.simpleString()}' for k in keys)}, batch long, day date").parquet(rows_at).filter(F.col("batch") < number)
            known = maybe_known(new, filters, keys).join(archive, [*keys, "day"], "left_semi")
            new = new.join(known.select(*keys), keys, "left_anti")
        part = f"{rows_at}/batch={number}"
        new.write.mode("overwrite").partitionBy("day").parquet(part)
        written = spark.read.schema(new.schema).parquet(part)
        filters_of(written, keys).write.mode("overwrite").parquet(f"{bits_at}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
