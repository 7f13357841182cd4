"""Day-partitioned shards: writing, reading a window, manifests, idempotent appends, sealed summaries, CSV."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import upsert_conflicts, upserted

#: Lines of a shard; about 32 MiB of events.
SHARD_ROWS = 50_000


def write_days(rows: DataFrame, path: str, close: str, order: list[str], fmt: str = "json", shard_rows: int = SHARD_ROWS) -> None:
    """One folder a UTC day, rows in canonical order within a file, files cut at a number of rows, never within one.

    Rows are dealt by range of (day, order), so a large day spreads over tasks instead of landing in one.
    """
    dated = rows.withColumn("day", F.date_format(F.col(close), "yyyy-MM-dd"))
    options = {"compression": "gzip"} if fmt == "json" else {}
    dated.repartitionByRange("day", *order).sortWithinPartitions("day", *order).write.mode("overwrite").option("maxRecordsPerFile", shard_rows).options(**options).partitionBy("day").format(fmt).save(path)


def read_days(spark: SparkSession, path: str, schema: T.StructType, first: str, last: str, fmt: str = "json") -> DataFrame:
    """Rows of a closed range of days; other days' folders are not opened."""
    full = T.StructType([*schema.fields, T.StructField("day", T.StringType())])
    return spark.read.schema(full).format(fmt).load(path).where(F.col("day").between(first, last))


def merge_days(spark: SparkSession, path: str, fresh: DataFrame, schema: T.StructType, key: str, close: str, order: list[str], target: str, fmt: str = "json") -> None:
    """Stored days with the fresh rows over them, written to ``target``: a commit is a new folder, never a half-written one."""
    days = fresh.select(F.date_format(F.col(close), "yyyy-MM-dd").alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b")).first()
    if days["a"] is None:
        return
    stored = read_days(spark, path, schema, days["a"], days["b"], fmt).drop("day")
    write_days(upserted(stored, fresh.select(*stored.columns), key), target, close, order, fmt)


def manifest(rows: DataFrame, ledger: str, close: str) -> DataFrame:
    """Per file: rows and the range of ledgers and closes, from one pass over the files."""
    return rows.groupBy(F.regexp_extract(F.input_file_name(), r"(day=[^/]+/[^/]+)$", 1).alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ledger).alias("first_ledger"), F.max(ledger).alias("last_ledger"), F.min(close).alias("first_close"), F.max(close).alias("last_close")
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and bytes of each file, read through Spark's own readers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"(day=[^/]+/[^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_entries(spark: SparkSession, path: str, rows: DataFrame, ledger: str, close: str) -> DataFrame:
    """The manifest of a folder: per file its rows, bytes, sha256 and ranges. A file without rows has a digest and no ranges."""
    return file_digests(spark, path).join(manifest(rows, ledger, close), "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def verify_files(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """Files whose digest is not the manifest's, files not listed and files missing: empty if all is well."""
    there = file_digests(spark, path)
    j = listed.select("file", F.col("sha256").alias("_want")).join(there, "file", "full")
    state = F.when(F.col("_want").isNull(), "UNMANIFESTED").when(F.col("sha256").isNull(), "MISSING").when(F.col("sha256") != F.col("_want"), "DIGEST_MISMATCH")
    return j.select("file", state.alias("problem")).where("problem is not null")


def verify_export(rows: DataFrame, key: str, close: str) -> DataFrame:
    """Rows filed under another day and keys in several rows, counted per day and problem."""
    misfiled = rows.where(F.date_format(F.col(close), "yyyy-MM-dd") != F.col("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("MISFILED"))
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("day")).where("n > 1").groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("DUPLICATE"))
    return misfiled.select("day", "problem", "n").unionByName(twice.select("day", "problem", "n"))


def manifest_digest(entries: DataFrame) -> DataFrame:
    """One row: the number of a manifest's entries and a sha256 over them in any order, by sums of their own digests."""
    line = F.sha2(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(entries.columns))).cast("binary"), 256)
    part = lambda at: F.sum(F.conv(F.substring("_line", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    g = entries.select(line.alias("_line")).agg(F.count(F.lit(1)).alias("entries"), *(part(at).alias(f"_{at}") for at in (1, 16, 31, 46)))
    return g.select("entries", F.sha2(F.concat_ws("|", "entries", "_1", "_16", "_31", "_46").cast("binary"), 256).alias("sha256"))


def archive_problems(files: DataFrame, totals: DataFrame, live: DataFrame) -> DataFrame:
    """day, problem and n: what an archive's listing contradicts.

    ``files`` has file, day, kind (events, payloads, participants), rows (claimed) and found (counted), ``totals`` has kind and rows, ``live`` day and n, the events of the
    database. ROW_COUNT counts files with other rows than claimed, PAYLOADS_EXCEED_EVENTS the payloads of a day without an event, TOTALS_DIFFER the kinds whose
    files do not add up to the total claimed (no day), DATABASE_DIFFERS by how many events a day of archive and database differ.
    """
    problem = lambda rows, name, n: rows.select("day", F.lit(name).alias("problem"), n.cast("long").alias("n"))
    off = files.where(~F.col("rows").eqNullSafe(F.col("found"))).groupBy("day").agg(F.count(F.lit(1)).alias("_n"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rows"))), F.lit(0))
    days = files.groupBy("day").agg(of("events").alias("_events"), of("payloads").alias("_payloads"))
    claimed = totals.select("kind", F.col("rows").alias("_claimed"))
    sums = files.groupBy("kind").agg(F.sum("rows").alias("_rows")).join(claimed, "kind", "full")
    unequal = sums.where(F.coalesce("_rows", F.lit(0)) != F.coalesce("_claimed", F.lit(0))).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").withColumn("day", F.lit(None).cast("string"))
    both = days.join(live.select("day", F.col("n").alias("_live")), "day", "full")
    apart = F.abs(F.coalesce("_events", F.lit(0)) - F.coalesce("_live", F.lit(0)))
    return (
        problem(off, "ROW_COUNT", F.col("_n")).unionByName(problem(days.where("_payloads > _events"), "PAYLOADS_EXCEED_EVENTS", F.col("_payloads") - F.col("_events")))
        .unionByName(problem(unequal, "TOTALS_DIFFER", F.col("_n"))).unionByName(problem(both.where(apart > 0), "DATABASE_DIFFERS", apart))
    )


def append_new(spark: SparkSession, path: str, fresh: DataFrame, key: str, compared: list[str]) -> int:
    """Append rows whose key is new; rows that are there already are left out; a contradiction refuses the whole batch."""
    stored = spark.read.parquet(path)
    clash = upsert_conflicts(stored, fresh, key, compared).limit(5).collect()
    if clash:
        raise ValueError(f"stored with other content: {[r[key] for r in clash]}")
    new = fresh.join(stored.select(key), key, "left_anti").dropDuplicates([key])
    n = new.count()
    if n:
        new.select(*stored.columns).write.mode("append").parquet(path)
    return n


def sealed(summary: DataFrame, most: int = 24 * 1024) -> str:
    """One summary row as canonical JSON with its sha256; refused if it is larger than a summary may be."""
    rows = summary.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary is one row")
    body = json.dumps(rows[0].asDict(recursive=True), sort_keys=True, separators=(",", ":"), default=str)
    if len(body.encode()) > most:
        raise ValueError("the summary is too large")
    return json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body}, separators=(",", ":"))


def opened(text: str) -> dict:
    outer = json.loads(text)
    if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["sha256"]:
        raise ValueError("the seal is broken")
    return json.loads(outer["body"])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
