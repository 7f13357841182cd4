"""Verification, archive, look-up and report records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import collection as C
from ..operators import merge as M
from ..operators import records as R
from ..operators import rollups
from ..sources import shards
from ..sources.tables import activity, sightings, table, transfers
from .registry import query
from .streaming_queries import folder


#: Day shards that queries only read, written once an application and folder of tables.
_SHARDS: dict[tuple[str, str], tuple] = {}


def _write(spark, d):
    """All transfers written as day shards."""
    at = folder(spark)
    t = transfers(spark, d, ["tx_hash", "ledger", "amount", "ts"]).select("tx_hash", "ledger", "amount", "ts")
    shards.write_days(t, at, "ts", ["ts", "tx_hash"], "parquet")
    return at, t.schema


def _written(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _SHARDS:
        _SHARDS[key] = _write(spark, d)
    return _SHARDS[key]


@query("s5_day_shards", "select tx_hash, ledger, cast(amount as double) as amount, strftime(ts, '%Y-%m-%d') as day from transfers where ts >= timestamp '1998-01-05' and ts < timestamp '1998-01-12'")
def _(spark, d):
    at, schema = _written(spark, d)
    return shards.read_days(spark, at, schema, "1998-01-05", "1998-01-11", "parquet").select("tx_hash", "ledger", F.col("amount").cast("double").alias("amount"), "day")


#: Only the days that fresh rows touch are written anew.
@query("s11_merge_days", """
select tx_hash, cast(case when tag % 3 = 0 then amount + 5 else amount end as double) as amount from transfers
where cast(ts as date) between (select min(cast(ts as date)) from transfers where tag % 3 = 0) and (select max(cast(ts as date)) from transfers where tag % 3 = 0)""")
def _(spark, d):
    at, schema = _written(spark, d)
    fresh = transfers(spark, d).where("tag % 3 = 0").withColumn("amount", (F.col("amount") + 5).cast("decimal(18,2)"))
    shards.merge_days(spark, at, fresh.select("tx_hash", "ledger", "amount", "ts"), schema, "tx_hash", "ts", ["ts", "tx_hash"], f"{at}-next", "parquet")
    return spark.read.schema(schema).parquet(f"{at}-next").select("tx_hash", F.col("amount").cast("double").alias("amount"))


@query("s12_idempotent_upsert", "select count(*) as n, count(distinct tx_hash) as distinct_hashes from transfers")
def _(spark, d):
    at = folder(spark)
    t = transfers(spark, d, ["tx_hash", "amount"]).select("tx_hash", "amount")
    t.where("amount > 40000").write.parquet(at)
    for _again in range(2):  # the second append adds nothing
        shards.append_new(spark, at, t, "tx_hash", ["amount"])
    return spark.read.parquet(at).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tx_hash").alias("distinct_hashes"))


@query("s13_csv_rollup", "select strftime(ts, '%Y-%m') as month, cast(sum(amount) as varchar) as total from transfers group by 1")
def _(spark, d):
    at = folder(spark)
    shards.write_csv(transfers(spark, d).groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("amount").alias("total")), at)
    return spark.read.schema("month string, total string").option("header", True).csv(at)


@query("s14_sealed_summary", "select count(*) as n, cast(sum(amount) as double) as total from transfers")
def _(spark, d):
    body = shards.opened(shards.sealed(transfers(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))))
    return spark.createDataFrame([(body["n"], body["total"])], "n long, total double")  # one row


@query("s15_manifest", """
select 'day=' || strftime(ts, '%Y-%m-%d') as day, count(*) as rows, min(ledger) as first_ledger, max(ledger) as last_ledger, true as hashed from transfers group by 1""")
def _(spark, d):
    at, schema = _written(spark, d)
    m = shards.manifest_entries(spark, at, spark.read.schema(schema).parquet(at), "ledger", "ts")
    hashed = F.bool_and((F.length("sha256") == 64) & (F.col("bytes") > 0)).alias("hashed")
    return m.groupBy(F.split("file", "/")[0].alias("day")).agg(F.sum("rows").alias("rows"), F.min("first_ledger").alias("first_ledger"), F.max("last_ledger").alias("last_ledger"), hashed)


@query("r1_export_verifier", """
with s as (select tx_hash, strftime(ts, '%Y-%m-%d') as day, ts from sightings), n as (select tx_hash, count(*) as n, min(case when ts < timestamp '1995-07-01' then '1995-06-30' else day end) as day from s group by 1)
select '1995-06-30' as day, 'MISFILED' as problem, count(*) as n from s where ts < timestamp '1995-07-01' and day <> '1995-06-30' union all select day, 'DUPLICATE', count(*) from n where n > 1 group by 1
union all select day, 'ROW_COUNT', 1 from f where dd = 13 union all select day, 'PAYLOADS_EXCEED_EVENTS', payloads - claimed from f where payloads > claimed
union all select null, 'TOTALS_DIFFER', 1 from f where dd = 13 having count(*) > 0 union all select day, 'DATABASE_DIFFERS', abs(claimed - live) from f where claimed <> live""".replace("), n as (", "), f as (select strftime(ts, '%Y-%m-%d') as day, day(ts) as dd, count(*) + case when day(ts) = 13 then 1 else 0 end as claimed, case when day(ts) = 23 then 0 else count(*) end as live, count(*) filter (tag % 4 <> 0) + case when day(ts) = 17 then 1000 else 0 end as payloads from sightings group by 1, 2), n as (", 1))
def _(spark, d):
    """Some days claim a row too many, some have payloads of no event, and one day a month is not in the database."""
    s = sightings(spark, d)
    filed = F.when(F.col("ts") < F.lit("1995-07-01").cast("timestamp_ntz"), "1995-06-30").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    g = s.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.dayofmonth("ts").alias("dd")).agg(F.count(F.lit(1)).alias("e"), F.count_if(F.col("tag") % 4 != 0).alias("p"))
    entry = lambda kind, rows, found: F.struct(F.lit(kind).alias("kind"), F.expr(rows).alias("rows"), F.expr(found).alias("found"))
    pays = "p + if(dd = 17, 1000L, 0L)"
    files = g.select("day", F.inline(F.array(entry("events", "e + if(dd = 13, 1L, 0L)", "e"), entry("payloads", pays, pays)))).withColumn("file", F.concat("day", F.lit("/"), "kind"))
    totals = files.groupBy("kind").agg(F.sum("found").alias("rows"))
    listed = shards.archive_problems(files, totals, g.where("dd <> 23").select("day", F.col("e").alias("n")))
    return shards.verify_export(s.withColumn("day", filed), "tx_hash", "ts").unionByName(listed)


@query("r2_backup_verifier", "select *, (select count(distinct cast(ts as date)) from transfers) as days from (values ('DIGEST_MISMATCH', 1), ('MISSING', 1), ('UNMANIFESTED', 1)) as v(problem, n)")
def _(spark, d):
    """A backup and the manifest written with it; later one file is damaged, one is lost and one turns up that nobody listed."""
    at, _schema = _write(spark, d)
    listed = shards.file_digests(spark, at)
    manifest = f"{at}-manifest"
    listed.write.parquet(manifest)
    listed = spark.read.parquet(manifest)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    damaged, lost = (r["file"] for r in listed.select("file").orderBy("file").limit(2).collect())
    for name in (damaged, damaged.rsplit("/", 1)[0] + "/stray.parquet"):
        out = fs.create(path(f"{at}/{name}"), True)
        out.writeBytes("damaged")
        out.close()
    fs.delete(path(f"{at}/{lost}"), False)
    days = listed.agg(F.countDistinct(F.split("file", "/")[0]).alias("days"))
    found = shards.verify_files(spark, at, listed).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    return found.crossJoin(days)  # one row


@query("r3_report_import", """
select sha256(text) as id, count(*) as copies, count(distinct lang) as variants, case when count(distinct lang) > 1 then 'VARIANTS' when count(*) > 1 then 'IDENTICAL_COPIES' else 'SINGLE' end as state from documents group by 1""", views=False)
def _(spark, d):
    t = table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("id"), "lang")
    return R.import_plan(t, "id", "lang").drop("content")


@query("r4_usable_receipt", "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey desc limit 1", views=False)
def _(spark, d):
    o = table(spark, d, "orders")
    return R.pick(o, F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("r5_archive_facts", """
select o_orderpriority as run, count(*) as target, count(*) filter (o_orderstatus = 'F') as proved, sum(case when o_orderstatus = 'F' then o_custkey end)::bigint as rows_committed, cast(null as bigint) as unmeasured from orders group by 1""", views=False)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), "o_orderstatus", "o_custkey")
    return R.archive_facts(o, ["run"], F.col("o_orderstatus") == "F", F.col("o_custkey"))


@query("r6_identity_merge", """
with n as (select s_suppkey as k, case when s_suppkey % 5 <> 0 then s_name end as found from supplier where not (s_suppkey % 4 = 0 and s_suppkey % 3 > 0))
select c_custkey as k, coalesce(case when c_custkey % 2 = 0 then c_name end, found) as name, case when c_custkey % 2 = 0 and found <> c_name then 'name' else '' end as conflicts from customer left join n on n.k = c_custkey""", views=False)
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    k, now = F.col("k"), F.lit("2024-01-31").cast("timestamp_ntz")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    # asked in vain six or eight days ago
    misses = s.where("k % 4 = 0").select("k", F.when(k % 3 > 0, F.lit("2024-01-25")).otherwise(F.lit("2024-01-23")).cast("timestamp_ntz").alias("asked"))
    answer = F.when(k % 10 == 0, "r" + "p" * 30).when(k % 5 == 0, F.repeat("s_name", 4)).otherwise(F.concat(F.lit(" "), "s_name"))
    found = M.lookups_due(s, misses, "k", "asked", now).select("k", M.usable_name(answer).alias("name"))
    return M.filled_slots(c, found, "k", ["name"]).withColumn("conflicts", F.array_join("conflicts", ","))


@query("r7_name_type", "select s_suppkey, case when s_suppkey % 3 = 0 then 'RIPPLE' when s_suppkey % 3 = 1 then 'EXCH' else 'HVT' end as type from supplier", views=False)
def _(spark, d):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("A Ripple "), "s_name")).when(k % 3 == 1, F.concat(F.lit("Kraken "), "s_name")).otherwise(F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", S.name_type(name).alias("type"))


@query("r8_balance_store", """
with r as (select o_custkey as k, o_totalprice as peak, epoch(o_orderdate)::bigint as peak_at, o_totalprice as last, o_orderkey as last_at, o_orderkey % 9 as n from orders)
select k, max(peak) as peak, arg_max(last, (last_at, last)) as last, max(n) as n from r group by 1""", views=False)
def _(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("peak"), F.unix_timestamp("o_orderdate").alias("peak_at"), F.col("o_totalprice").alias("last"), F.col("o_orderkey").alias("last_at"), (F.col("o_orderkey") % 9).alias("n"))
    return R.balance_store(r.where("last_at % 2 = 0"), r.where("last_at % 2 = 1"), "k").select("k", "peak", "last", "n")


@query("r9_drain_alerts", """
with g as (select receiver as k, max(amount) as peak, arg_max(amount, (ts, tx_hash)) as last from transfers group by 1)
select k, cast(last as double) / cast(peak as double) as ratio, case when cast(last as double) / cast(peak as double) <= 0.05 then 'DRAINED' else 'BLEEDING' end as state from g where cast(last as double) / cast(peak as double) <= 0.6""")
def _(spark, d):
    g = transfers(spark, d).groupBy(F.col("receiver").alias("k")).agg(F.max("amount").cast("double").alias("peak"), F.max_by("amount", F.struct("ts", "tx_hash")).cast("double").alias("last"))
    ratio = F.col("last") / F.col("peak")
    return g.select("k", ratio.alias("ratio"), F.when(ratio <= 0.05, "DRAINED").otherwise("BLEEDING").alias("state")).where("ratio <= 0.6")


@query("r10_snapshot_diff", """
select coalesce(a.c_custkey, b.c_custkey) as c_custkey, case when a.c_custkey is null then 'ADDED' when b.c_custkey is null then 'REMOVED' else 'CHANGED' end as change
from (select * from customer where c_custkey % 5 > 0) a full join (select c_custkey, case when c_custkey % 7 = 0 then 0 else c_acctbal end as c_acctbal from customer where c_custkey % 3 > 0) b on a.c_custkey = b.c_custkey
where a.c_custkey is null or b.c_custkey is null or a.c_acctbal <> b.c_acctbal""", views=False)
def _(spark, d):
    c = table(spark, d, "customer")
    new = c.where("c_custkey % 3 > 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, 0.0).otherwise(F.col("c_acctbal")))
    return M.snapshot_diff(c.where("c_custkey % 5 > 0"), new, "c_custkey", ["c_acctbal"])


@query("r11_distinct_index", "select count(distinct tx_hash) as hashes, count(distinct receiver) as addresses from sightings")
def _(spark, d):
    return sightings(spark, d).agg(F.countDistinct("tx_hash").alias("hashes"), F.countDistinct("receiver").alias("addresses"))


@query("r14_daily_archive", """
select cast(o_orderdate as date) as day, min(o_orderkey) as o_orderkey from orders where o_orderstatus = 'F' group by 1 order by 1 desc limit 500""", views=False)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return R.first_per_day(o, F.to_date("o_orderdate"), F.col("o_orderstatus") == "F", ["o_orderkey"], 500).select("day", "o_orderkey")


@query("r15_on_this_day", "select o_orderkey from orders where strftime(o_orderdate, '%m-%d') = '03-14' and strftime(o_orderdate, '%Y') <> '1998'", views=False)
def _(spark, d):
    return R.on_this_day(table(spark, d, "orders"), "o_orderdate", "1998-03-14").select("o_orderkey")


@query("r16_report_merge", """
with r as (select o_custkey as id, max(o_orderkey) as v from orders where o_custkey % 2 = 0 group by 1)
select id, v from r union all select o_custkey, o_orderkey from orders where o_custkey % 4 = 0 and o_orderkey not in (select v from r)""", views=False)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("v"))
    return R.merged_reports(o.where("id % 4 = 0"), o.where("id % 2 = 0"), "id", "v", ["v"])


@query("r17_wallet_history", """
with l as (select sender as account, -amount as signed, ts, tx_hash from transfers union all select receiver, amount, ts, tx_hash from transfers),
n as (select *, row_number() over (partition by account order by ts desc, tx_hash, signed) as rn from l)
select account, count(*) as n, cast(coalesce(sum(signed) filter (signed > 0), 0) as double) as came_in, cast(coalesce(-sum(signed) filter (signed < 0), 0) as double) as went_out from n where rn <= 25 group by 1""")
def _(spark, d):
    return R.wallet_history(transfers(spark, d), "sender", "receiver", "amount", "ts", "tx_hash")


@query("r18_graph_expand", """
with b as (select sender as center, receiver as other, ts, tx_hash from transfers union all select receiver, sender, ts, tx_hash from transfers),
n as (select *, row_number() over (partition by center order by ts desc, tx_hash, other) as rn from b where center % 10 = 0)
select distinct center, other from n where rn <= 10 and center <> other""")
def _(spark, d):
    centers = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("center"))
    return R.expansion(transfers(spark, d), centers, "sender", "receiver", "ts", "tx_hash")


@query("r19_discovery_inbox", """
select address, case when address % 5 = 0 then 'PROMOTED_TO_HVT' when address % 3 = 0 then 'APPROVED' when address % 2 = 0 then 'REJECTED' else 'NEW' end as status from (select distinct sender as address from transfers where amount > 95000)""")
def _(spark, d):
    found = transfers(spark, d).where("amount > 95000").select(F.col("sender").alias("address")).distinct()
    seen = found.where("address % 5 = 0 or address % 3 = 0 or address % 2 = 0").select("address", F.when(F.col("address") % 5 == 0, "PROMOTED_TO_HVT").when(F.col("address") % 3 == 0, "APPROVED").otherwise("REJECTED").alias("status"))
    return M.appended(seen, found.withColumn("status", F.lit("NEW")), "address")


@query("r20_identity_resolve", """
select distinct sender as address, coalesce(s_name, case when c_custkey % 2 = 0 then c_name end, 'unknown') as name, case when s_name is not null then 'HIGH' when c_custkey % 2 = 0 then 'LOW' else 'NONE' end as confidence
from transfers left join supplier on s_suppkey = sender left join customer on c_custkey = sender""")
def _(spark, d):
    who = transfers(spark, d).select(F.col("sender").alias("address")).distinct()
    s, c = table(spark, d, "supplier").select("s_suppkey", "s_name"), table(spark, d, "customer").select("c_custkey", "c_name")
    j = who.join(s, F.expr("s_suppkey = address"), "left").join(c, F.expr("c_custkey = address"), "left")
    cold = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    return j.select("address", F.coalesce("s_name", cold, F.lit("unknown")).alias("name"), F.when(F.col("s_name").isNotNull(), "HIGH").when(cold.isNotNull(), "LOW").otherwise("NONE").alias("confidence"))


@query("r21_case_file", "select distinct tx_hash from sightings where sender = 11 or receiver = 11")
def _(spark, d):
    return sightings(spark, d).where("sender = 11 or receiver = 11").select("tx_hash").dropDuplicates()


@query("r22_collection_loop", """
with l as (select ledger, count(*) as n, row_number() over (order by ledger) as rn, min(ledger) over () as a from transfers where ledger % 1000 < 990 group by 1),
g as (select *, ledger - rn as g0, first(ledger - rn) over (order by ledger) as g from l)
select ledger, n from g where g0 = g""")
def _(spark, d):
    from ..streaming.flows import gaps

    t = transfers(spark, d).where("ledger % 1000 < 990")
    counts = t.groupBy("ledger").agg(F.count(F.lit(1)).alias("n"))
    stop = gaps(counts, "ledger").agg(F.min("missing_from").alias("stop"))  # one row: collection ends at the first gap
    return counts.crossJoin(F.broadcast(stop)).where("stop is null or ledger < stop").select("ledger", "n")


@query("r22_budgeted_run", """
with l as (select o_orderkey as ledger, floor(o_totalprice)::bigint as bytes from orders where o_orderkey >= 1), c as (select ledger, count(*) over w as n, sum(bytes) over w as bytes, sum(bytes) over w - bytes as was, bytes as own from l window w as (order by ledger)),
x as (select *, case when ledger <> 1 + n - 1 then 'LEDGER_MISSING' when ledger % 1009 = 0 then 'CHAIN_MISMATCH' when own > 900000 then 'OBJECT_SIZE_STOP' when bytes > 200000000 or 2 * (n - 1) >= 2000 then 'RUN_BUDGET_STOP' end as stop from c),
m as (select min(ledger) as halt, arg_min(stop, ledger) as reason, arg_min(n - 1, ledger) as done from x where stop is not null), e as (select max(ledger) as hi, max(n) as n from x)
select x.ledger, x.n, cast(x.bytes as bigint) as bytes, 1 + coalesce(done, e.n) as next, hi - coalesce(done, e.n) as remaining, case when 1 + coalesce(done, e.n) <= hi then reason end as reason from x, m, e where halt is null or x.ledger < halt""", views=False)
def _(spark, d):
    """Orders are ledgers, two requests each; receipts with the outcome beside them."""
    o = table(spark, d, "orders").selectExpr("o_orderkey as ledger", "if(o_orderkey % 1009 = 0, 'CHAIN_MISMATCH', null) as problem", "cast(floor(o_totalprice) as bigint) as bytes", "2 as requests", "1 as ms")
    end = o.agg(F.max("ledger")).first()[0] or 0
    receipts, outcome = C.collected(o, 1, end, {"object": 900_000, "bytes": 200_000_000, "requests": 2_000})
    return receipts.select("ledger", "n", "bytes").crossJoin(F.broadcast(outcome.select("next", "remaining", "reason")))  # one row


@query("r23_budget_ledger", """
select o_orderpriority as day, cast(sum(coalesce(case when o_orderkey % 3 = 0 then cast(o_totalprice as decimal(18,2)) * 2 end, cast(o_totalprice as decimal(18,2)))) as double) as counts,
  count(*) filter (o_orderkey % 3 = 0) as breaches from orders where o_totalprice > 1 and o_orderkey % 3 <> 1 group by 1""", views=False)
def _(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 1 and o_orderkey % 3 <> 1").select("o_orderkey", F.col("o_orderpriority").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("reserved"))
    s = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("reserved") * 2).alias("settled"))
    return R.budget(o, s, "o_orderkey").groupBy("day").agg(F.sum("counts").cast("double").alias("counts"), F.count_if("breach").alias("breaches"))


@query("r24_next_slot", "select event_id, (cast(floor(epoch(ts) / 7200) as bigint) + 1) * 7200 as slot, 1705276800 >= (cast(floor(epoch(ts) / 7200) as bigint) + 1) * 7200 + 3600 as overdue from events", views=False)
def _(spark, d):
    slot = R.next_slot(F.unix_timestamp("ts"))
    return table(spark, d, "events").select("event_id", slot.alias("slot"), R.overdue(slot, F.lit(1_705_276_800)).alias("overdue"))


@query("r25_window_proven", "select o_orderkey, o_orderstatus = 'F' or (o_orderkey % 4 > 0 and o_custkey <= 700) as proven from orders", views=False)
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.window_proven(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")), F.lit(700)).alias("proven"))


@query("r26_staged_payload", "select tx_hash, first(tag order by quantity desc, ts, receiver, tag) as payload from sightings group by 1")
def _(spark, d):
    return R.staged_payload(sightings(spark, d), "tx_hash", "quantity", ["ts", "receiver", "tag"], "tag")


@query("r27_coverage_text", """
select o_custkey as k, case when count(*) filter (o_orderkey % 2 = 0) = 0 then 'NOT MEASURED' when count(*) filter (o_orderkey % 2 = 0 and o_orderstatus = 'F') = count(*) filter (o_orderkey % 2 = 0) then 'COMPLETE' else 'INCOMPLETE' end as text from orders group by 1""", views=False)
def _(spark, d):
    even = F.col("o_orderkey") % 2 == 0
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(even).alias("t"), F.count_if(even & (F.col("o_orderstatus") == "F")).alias("p"))
    return g.select("k", R.coverage_text(F.col("t"), F.col("p")).alias("text"))


@query("r28_overview", """
select 'collector' as section, count(*) as n, case when max(ts) < timestamp '2024-02-10' then null else cast(sum(value) as double) end as total from activity
union all select 'wallets', count(distinct account), cast(sum(value) as double) from activity union all select 'alerts', count(*) filter (type = 'error'), null from activity""")
def _(spark, d):
    a = activity(spark, d)
    stale = F.max("ts") < F.lit("2024-02-10").cast("timestamp_ntz")
    one = a.agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("t"), stale.alias("s"), F.countDistinct("account").alias("w"), F.count_if(F.col("type") == "error").alias("e"))
    none = F.lit(None).cast("double")
    rows = F.array(
        F.struct(F.lit("collector").alias("section"), F.col("n").alias("n"), F.when(~F.col("s"), F.col("t")).alias("total")), F.struct(F.lit("wallets").alias("section"), F.col("w").alias("n"), F.col("t").alias("total")),
        F.struct(F.lit("alerts").alias("section"), F.col("e").alias("n"), none.alias("total")),
    )
    return one.select(F.inline(rows))


@query("r29_backward_walk", """
select o_custkey as k, count(*) as pages, case when min(o_orderdate) <= timestamp '1995-06-01' then 'BOUNDARY' when bool_or(o_orderstatus = 'P') then 'EXHAUSTED' when count(*) >= 10 then 'TRUNCATED' else 'RUNNING' end as state from orders group by 1""", views=False)
def _(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("pages"), (F.min("o_orderdate") <= F.lit("1995-06-01").cast("timestamp_ntz")).alias("b"), F.bool_or(F.col("o_orderstatus") == "P").alias("e"))
    return g.select("k", "pages", R.walk_state(F.col("b"), F.col("e"), F.col("pages"), 10).alias("state"))


@query("r29_walked_rows", """
with r as (select o_custkey as k, case when o_custkey % 7 = 0 then 1 + o_orderkey % 5 when o_custkey % 3 = 0 then 1 + o_orderkey % 2 else 1 end as attempt, cast(2002 - year(o_orderdate) as int) as page, o_orderdate as close, o_orderkey % 11 > 0 as more from orders),
p as (select k, attempt, page, min(close) as oldest, bool_or(more) as more from r where page <= 6 group by all), e as (select k, attempt, min(page) filter (oldest <= timestamp '1996-06-01' or not more) as stop, max(page) as last from p group by all),
l as (select k, max(attempt) as attempt, arg_max(stop, attempt) filter (true) as s0 from e group by 1), w as (select l.k, l.attempt, e.stop, e.last from l join e on e.k = l.k and e.attempt = l.attempt),
z as (select w.*, p.oldest <= timestamp '1996-06-01' as reached from w left join p on p.k = w.k and p.attempt = w.attempt and p.page = w.stop)
select z.k, z.attempt, coalesce(stop, last) as through_page, case when z.attempt > 4 then 'UNPROVEN' when stop is not null then case when reached then 'BOUNDARY' else 'EXHAUSTED' end when last >= 6 then 'TRUNCATED' else 'RUNNING' end as state,
  (select count(*) from r where r.k = z.k and r.attempt = z.attempt and r.page <= coalesce(stop, last) and r.close between timestamp '1996-06-01' and timestamp '1998-06-01') as rows from z""", views=False)
def _(spark, d):
    """Customers are accounts, years are pages, the newest first; some changed transport once or more."""
    r = table(spark, d, "orders").selectExpr(
        "o_custkey as k", "case when o_custkey % 7 = 0 then 1 + o_orderkey % 5 when o_custkey % 3 = 0 then 1 + o_orderkey % 2 else 1 end as attempt", "2002 - year(o_orderdate) as page", "o_orderdate as close", "o_orderkey % 11 > 0 as more"
    )
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("1996-06-01", "1998-06-01"))
    walks = C.backward_walk(r, ["k"], start, 6)
    n = C.walked_rows(r, walks, ["k"], start, end).groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    return walks.join(n, "k", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


@query("r30_watch_level", """
select c_custkey as k, case when c_custkey % 5 = 0 then 'WITHHELD_SEVERE' when c_custkey % 5 = 1 then 'WITHHELD_DEGRADED' when c_custkey % 100 >= 75 then 'high' when c_custkey % 100 >= 50 then 'elevated' when c_custkey % 100 >= 25 then 'moderate' else 'low' end as level from customer""", views=False)
def _(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), S.watch_level(k % 100, F.when(k % 5 == 0, 50).when(k % 5 == 1, 90).otherwise(100), F.lit(100)).alias("level"))


@query("r31_executive_gate", "select cast(ts as date) as day, sum(amount) >= 1000000 and count(*) filter (amount >= 90000) >= 2 as stated from transfers group by 1")
def _(spark, d):
    return transfers(spark, d).groupBy(F.to_date("ts").alias("day")).agg(rollups.elevated("amount", 90_000, 2, 1_000_000, both=True).alias("stated"))


@query("r32_wallet_outcomes", """
select case when c_custkey % 9 = 0 then 'RECOVERED' when o is null then 'NOT_ATTEMPTED' else o end as outcome, count(*) as n from customer left join (select o_custkey, max(case o_orderstatus when 'F' then 'COMPLETE' when 'P' then 'ABANDONED' else 'FAILED' end) as o from orders where o_custkey % 4 > 0 group by 1) x on o_custkey = c_custkey group by 1""", views=False)
def _(spark, d):
    s = F.col("o_orderstatus")
    o = table(spark, d, "orders").where("o_custkey % 4 > 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(s == "F", "COMPLETE").when(s == "P", "ABANDONED").otherwise("FAILED")).alias("o"))
    c = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return R.outcomes(c, c.where("c_custkey % 9 = 0"), "c_custkey", "o")


@query("r33_run_freshness", """
with o as (select o_orderpriority as run, case when o_orderstatus = 'P' and o_orderpriority in ('1-URGENT', '3-MEDIUM') then 'CONTRADICTION' when o_orderstatus = 'P' then 'ABANDONED' when o_orderpriority = '5-LOW' and o_orderkey % 7 = 0 then 'LOST'
  when o_orderstatus = 'O' then (case when o_orderkey % 2 = 0 then 'AWAITING' else 'NOT_ATTEMPTED' end) when o_orderkey % 5 = 0 then 'RECOVERED' when o_orderkey % 5 = 1 then 'ADMITTED' else 'COMPLETE' end as outcome from orders)
select run, count(*) filter (outcome in ('COMPLETE', 'RECOVERED', 'ADMITTED')) as proven, count(*) filter (outcome = 'RECOVERED') as recovered, count(*) filter (outcome = 'LOST') as unavailable, count(*) filter (outcome = 'CONTRADICTION') as contradicted,
  count(*) filter (outcome = 'ADMITTED') as admitted, count(*) filter (outcome = 'AWAITING') as awaiting, count(*) filter (outcome = 'NOT_ATTEMPTED') as not_attempted, count(*) filter (outcome = 'ABANDONED') as abandoned, count(*) filter (outcome in ('LOST', 'CONTRADICTION')) = 0 as advances from o group by 1""", views=False)
def _(spark, d):
    s, run, k = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")
    outcome = (
        F.when((s == "P") & run.isin("1-URGENT", "3-MEDIUM"), "CONTRADICTION").when(s == "P", "ABANDONED").when((run == "5-LOW") & (k % 7 == 0), "LOST")
        .when(s == "O", F.when(k % 2 == 0, "AWAITING").otherwise("NOT_ATTEMPTED")).when(k % 5 == 0, "RECOVERED").when(k % 5 == 1, "ADMITTED").otherwise("COMPLETE")
    )
    return R.run_freshness(table(spark, d, "orders").select(run.alias("run"), outcome.alias("outcome")), ["run"], "outcome")


@query("r34_archive_write", """
select o_orderkey as id, case when o_orderkey % 3 > 0 then 'WRITE' when o_orderkey % 2 = 0 then 'ALREADY_ARCHIVED' else 'CONFLICT' end as action from orders""", views=False)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    stored = o.where("id % 3 = 0").withColumn("c", F.when(F.col("id") % 2 == 0, F.col("c")).otherwise(-1))
    return R.archive_write(stored, o, "id", "c")


@query("r35_journal_append", "select o_orderkey as id, o_orderkey % 2 = 0 as was_there from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0", views=False)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return M.appended(o.where("id % 2 = 0").withColumn("was_there", F.lit(True)), o.where("id % 3 = 0").withColumn("was_there", F.lit(False)), "id")


@query("p_elevated", "select cast(ts as date) as day, count(*) filter (amount >= 50000) >= 10 or sum(amount) >= 1000000 as elevated from transfers group by 1")
def _(spark, d):
    return transfers(spark, d).groupBy(F.to_date("ts").alias("day")).agg(rollups.elevated("amount", 50_000, 10, 1_000_000).alias("elevated"))


@query("p_escrow_not_move", "select o_orderkey, o_orderpriority from orders where lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) not in ('urgent', 'notspecified')", views=False)
def _(spark, d):
    letters = F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", ""))
    return table(spark, d, "orders").where(~letters.isin("urgent", "notspecified")).select("o_orderkey", "o_orderpriority")


@query("report_contract_rows", """
with c as (select kind as section, cast(ts as date) as headline, cast(sum(amount) as double) as weight from transfers group by 1, 2)
select section, headline, weight from (select *, row_number() over (partition by section order by weight desc, headline) as rn from c) where rn = 1""")
def _(spark, d):
    c = transfers(spark, d).groupBy(F.col("kind").alias("section"), F.to_date("ts").alias("headline")).agg(rollups.total("amount").alias("weight"))
    return R.contract_rows(c, "section", "weight", "headline")
