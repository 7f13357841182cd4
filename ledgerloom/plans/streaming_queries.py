"""Streams over the events and transfers, driven to completion and compared with their batch meaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import journal as J
from ..shipping import shipped
from ..sources.tables import activity, table, transfers
from ..streaming import flows as S
from .registry import query


def folder(spark) -> str:
    """A fresh folder that all executors share: in spark.checkpoint.dir; a local session may use this machine's."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base}/stream-{uuid.uuid4().hex}"


def through(spark, sf_dir, build, mode="append", files=1):
    """The rows a streaming query over the events table leaves behind: the last state of each of its batches."""
    at = folder(spark)
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    out = build(rows)
    S.run_available(out, f"{at}/state", lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), mode)
    return spark.read.schema(out.schema).parquet(f"{at}/out").drop("batch")


@query("t1_stream_dispatch", "select event_type as type, count(*) as n from events group by 1", views=False)
def _(spark, d):
    return through(spark, d, lambda r: r.select(F.col("event_type").alias("type"), "event_id")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("t2_live_classify", "select event_id, case when value * 1000 >= 100000 then 'whale' when value * 1000 >= 10000 then 'shark' else 'fish' end as band from events where not (event_type = 'click' and value < 1)", views=False)
def _(spark, d):
    return through(spark, d, lambda r: S.classified(r.where("not (event_type = 'click' and value < 1)").withColumn("a", F.col("value") * 1000), "a").select("event_id", "band"))


@query("t3_alerts", "select event_id from events where event_type <> 'error' and (value * 1000 >= 100000 or user_id % 50 = 0) and event_type <> 'view'", views=False)
def _(spark, d):
    e = F.col("event_type")
    return through(spark, d, lambda r: S.alerts(r.withColumn("a", F.col("value") * 1000), e != "error", "a", F.col("user_id") % 50 == 0, e == "view").select("event_id"))


@query("t4_daily_totals", "select cast(ts as date) as day, count(*) as n, cast(sum(cast(value as decimal(18,4))) as double) as total from events group by 1", views=False)
def _(spark, d):
    out = through(spark, d, lambda r: S.daily(r.withColumn("v", F.col("value").cast("decimal(18,4)")), "ts", "v"), "complete")
    return out.select("day", "n", F.col("total").cast("double").alias("total"))


@query("t5_sliding_hour", """
with w as (select user_id, epoch(time_bucket(interval 15 minutes, ts))::bigint - 900 * k as start from events, (values (0), (1), (2), (3)) s(k))
select start, user_id, count(*) as n from w group by 1, 2 having count(*) >= 3""", views=False)
def _(spark, d):
    return through(spark, d, lambda r: S.sliding(r, "ts", "user_id"), "complete").where("n >= 3")


@query("t5_escrow_lookback", "select event_id, case when dayofweek(ts) in (6, 0, 1) then 96 else 36 end as hours from events", views=False)
def _(spark, d):
    return activity(spark, d).select("event_id", S.lookback_hours(F.col("ts")).alias("hours"))


@query("t6_stream_dedupe", "select count(distinct event_id) as n from events", views=False)
def _(spark, d):
    return through(spark, d, lambda r: S.deduplicated(r.union(r), "event_id", "ts").select("event_id")).agg(F.count(F.lit(1)).alias("n"))


@query("t7_exactly_once", "select count(*) as n, cast(sum(event_id) as double) as ids from events", views=False)
def _(spark, d):
    at = folder(spark)
    rows = S.stream_table(spark, f"{d}/events.parquet*", table(spark, d, "events").schema, 1)
    for _again in range(2):  # the second run finds nothing new
        S.run_available(rows, f"{at}/state", S.receipts(f"{at}/out", "event_id"))
    return spark.read.parquet(f"{at}/out").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").cast("double").alias("ids"))


@query("t8_ledger_gaps", """
with l as (select distinct ledger from transfers where ledger % 10 <> 3), n as (select ledger, lead(ledger) over (order by ledger) as nx from l)
select ledger + 1 as missing_from, nx - 1 as missing_to from n where nx > ledger + 1""")
def _(spark, d):
    return S.gaps(transfers(spark, d).where("ledger % 10 <> 3"), "ledger")


@query("t9_freshness", "select account, case when epoch(timestamp '2024-01-31') - max(epoch(ts)::bigint) > 43200 then 'STALE' else 'FRESH' end as state from activity group by 1")
def _(spark, d):
    last = activity(spark, d).groupBy("account").agg(F.max(F.unix_timestamp("ts")).alias("t"))
    return last.select("account", S.freshness(F.unix_timestamp(F.lit("2024-01-31").cast("timestamp_ntz")) - F.col("t"), 43200).alias("state"))


@query("t10_resumable_journal", """
with l as (select o_custkey as wallet, o_orderkey as pos, o_orderkey - o_orderkey % 50 as lo, case when o_orderkey % 9 = 0 then o_orderkey - 400 when o_orderkey % 31 > 0 then o_orderkey end as hi, o_orderkey % 6 as rows, o_orderstatus = 'P' as bad, (select max(o_orderkey) - 3000 from orders) as anchor from orders),
b as (select *, max(case when hi <= anchor then hi end) over (partition by wallet order by pos rows between unbounded preceding and 1 preceding) as before from l),
j as (select *, case when hi is null or hi > anchor then 'WRONG_ANCHOR' when before >= anchor then 'ALREADY_RECORDED' when hi <= before then 'NOT_ADVANCED' end as refused from b)
select wallet, coalesce(refused, 'MERGED') as state, min(case when refused is null then lo end) as lo, max(case when refused is null then hi end) as hi, coalesce(sum(rows) filter (refused is null), 0)::bigint as rows,
  case when refused is null then bool_or(bad) end as contradicted, count(*) as legs from j group by 1, 2, refused""", views=False)
def _(spark, d):
    """Legs come as a stream, twenty of whose batches might be one file each; each batch reads the journal the one before left, so a batch that comes again writes what it wrote."""
    at, k = folder(spark), F.col("o_orderkey")
    anchor = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    anchor = None if anchor is None else anchor - 3000
    rows = S.stream_table(spark, f"{d}/orders.parquet*", table(spark, d, "orders").schema, 1).select(
        F.col("o_custkey").alias("wallet"), k.alias("at"), (k - k % 50).alias("proven_from"), F.when(k % 9 == 0, k - 400).when(k % 31 > 0, k).alias("proven_through"), (k % 6).alias("rows"),
        F.when(F.col("o_orderstatus") == "P", "CONTRADICTION").otherwise("PROVEN").alias("reconciliation"),
    )

    def step(df, n):
        journal = spark.read.parquet(f"{at}/journal/{n - 1}") if n else None
        legs = J.judged(df, journal, anchor or 0, "at")
        legs.where("refused is not null").write.mode("overwrite").parquet(f"{at}/refused/batch={n}")
        J.merged(journal, legs.where("refused is null")).write.mode("overwrite").parquet(f"{at}/journal/{n}")
        spark.range(1).write.mode("overwrite").parquet(f"{at}/done/batch={n}")

    S.run_available(rows, f"{at}/state", step)
    last = spark.read.parquet(f"{at}/done").agg(F.max("batch")).first()[0]
    done = spark.read.parquet(f"{at}/journal/{last}").select(
        "wallet", F.lit("MERGED").alias("state"), F.col("proven_from").alias("lo"), F.col("proven_through").alias("hi"), "rows", (F.col("reconciliation") == "CONTRADICTION").alias("contradicted"), F.col("legs").cast("long").alias("legs")
    )
    refused = spark.read.parquet(f"{at}/refused").groupBy("wallet", F.col("refused").alias("state")).agg(F.count(F.lit(1)).alias("legs"))
    none = F.lit(None)
    return done.unionByName(refused.select("wallet", "state", none.cast("long").alias("lo"), none.cast("long").alias("hi"), F.lit(0).cast("long").alias("rows"), none.cast("boolean").alias("contradicted"), "legs"))


@query("t11_admission_clock", """
with o as (select user_id % 64 as endpoint, list(event_type <> 'error' order by ts, event_id) as oks, count(*) as requests, count(*) filter (event_type = 'error') as refusals from events group by 1),
s as (select *, list_transform(oks, lambda k: {gap: 250::double, run: 0, ok: k}) as steps from o)
select endpoint, cast(list_reduce(steps, lambda a, x: case when not x.ok then {gap: least(2000, greatest(1000, a.gap * 2)), run: 0, ok: x.ok} when a.run + 1 < 5 then {gap: a.gap, run: a.run + 1, ok: x.ok}
  else {gap: greatest(250, floor(a.gap * 0.7::double)), run: 0, ok: x.ok} end, {gap: 250::double, run: 0, ok: true}).gap as bigint) as gap_ms, requests, refusals from s""", views=False)
def _(spark, d):
    shipped(spark)
    rows = lambda r: S.admission_gaps(r.withColumn("endpoint", F.col("user_id") % 64).withColumn("ok", F.col("event_type") != "error"), "endpoint", ["ts", "event_id"], "ok")
    out = through(spark, d, rows, "update")
    return out.groupBy("endpoint").agg(F.max_by("gap_ms", "requests").alias("gap_ms"), F.max("requests").alias("requests"), F.max("refusals").alias("refusals"))


@query("t_keyed_state", "select user_id, count(*) as seen, max(cast(floor(epoch(ts)) as bigint)) as latest from events group by 1", views=False)
def _(spark, d):
    out = through(spark, d, lambda r: S.running_counts(r, "user_id", "ts"), "update")
    return out.groupBy("user_id").agg(F.max("seen").alias("seen"), F.max("latest").alias("latest"))
