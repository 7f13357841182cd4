"""Aggregations on the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import merge as M
from ..operators import patterns as P
from ..operators import rollups as R
from ..sources.tables import ARRIVAL, activity, sightings, table, transfers
from .registry import query

_ORDER = "order by ts, receiver, tag, amount, quantity, discount, fee, kind, result"


@query("a1_merge_sightings", f"""
with s as (select *, case when tag % 3 = 0 then tag end as gap from sightings)
select tx_hash, count(*) as sightings, array_to_string(list_sort(list(distinct receiver)), ',') as observers,
  first(gap {_ORDER}) filter (gap is not null) as gap, first(kind {_ORDER}) as kind,
  concat_ws(',', case when min(amount) <> max(amount) then 'amount' end, case when min(kind) <> max(kind) then 'kind' end, case when min(ts) <> max(ts) then 'ts' end) as conflicts,
  first(tag order by quantity desc, ts, receiver, tag, amount, quantity, discount, fee, kind, result) as payload,
  array_to_string(list_sort(list_distinct(flatten(list(case when tag % 2 = 0 then ['s' || (tag % 7), 's' || tx_index] else [] end)))), ',') as signers
from s group by 1""")
def _(spark, d):
    signer = lambda c: F.concat(F.lit("s"), c.cast("string"))
    signers = F.when(F.col("tag") % 2 == 0, F.array(signer(F.col("tag") % 7), signer(F.col("tx_index")))).otherwise(F.array().cast("array<string>"))
    s = sightings(spark, d).withColumn("gap", F.when(F.col("tag") % 3 == 0, F.col("tag"))).withColumn("signers", signers)
    m = M.merge_sightings(s, "tx_hash", list(ARRIVAL), "receiver", ["gap", "kind"], ["amount", "kind", "ts"], "quantity", "tag", ("signers",))
    lists = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("observers", "conflicts", "signers")}
    return m.withColumns(lists)


@query("a2_dedupe_by_hash", "select tx_hash, sender, receiver, cast(amount as double) as amount, tag from transfers")
def _(spark, d):
    return transfers(spark, d).select("tx_hash", "sender", "receiver", F.col("amount").cast("double").alias("amount"), "tag")


@query("a3_exchange_totals", """
select sender as account, kind as asset, cast(coalesce(sum(amount) filter (result = 'O'), 0) as double) as sell, cast(coalesce(sum(amount) filter (result <> 'O'), 0) as double) as buy,
  cast(coalesce(sum(quantity) filter (result = 'O'), 0) as double) as received, cast(coalesce(sum(quantity) filter (result <> 'O'), 0) as double) as spent, count(*) as legs
from transfers group by 1, 2""")
def _(spark, d):
    t = transfers(spark, d).withColumnRenamed("sender", "account").withColumnRenamed("kind", "asset")
    return R.exchange_totals(t, "account", "asset", F.col("result") == "O", "amount", "quantity")


@query("a4_sent_received", """
select account, cast(sum(sent) as double) as sent, cast(sum(received) as double) as received, count(*) as legs from (
  select sender as account, amount as sent, 0.00 as received from transfers where sender <> receiver
  union all select receiver, 0.00, amount from transfers where sender <> receiver) group by 1""")
def _(spark, d):
    return R.two_sided(transfers(spark, d).where("sender <> receiver"), "sender", "receiver", "amount")


@query("p_direct", """
select account, cast(sum(sent) as double) as sent, cast(sum(received) as double) as received, count(*) as legs from (
  select *, kind <> 'R' and sender <> receiver and not coalesce(case when tag % 7 > 0 then tag % 6 = 0 end, false) as direct from transfers) t, lateral (values (sender, amount, 0.00), (receiver, 0.00, amount)) as l(account, sent, received)
where direct group by 1""")
def _(spark, d):
    """Payments in the native asset from one to another; a few asked for another currency, of some it is not known."""
    t = transfers(spark, d, ["sender", "receiver", "amount", "kind", "tag"])
    direct = S.direct_payment(F.when(F.col("kind") != "R", "XRP").otherwise("USD"), F.col("sender"), F.col("receiver"), F.expr("if(tag % 7 > 0, tag % 6 = 0, null)"))
    return R.two_sided(t.where(direct), "sender", "receiver", "amount")


@query("a5_status_histogram", "select result as status, count(*) as n from transfers group by 1")
def _(spark, d):
    return transfers(spark, d).groupBy(F.col("result").alias("status")).agg(F.count(F.lit(1)).alias("n"))


_FLAGS = """flags as (
  select 'REPEATED_LIMIT_PRICE' as kind, receiver as account, count(*) as n from transfers group by receiver, kind, discount, fee having count(*) >= 3
  union all select 'REPEATED_CONFIRMED_CANCEL', receiver, count(*) from transfers where kind = 'R' group by receiver having count(*) >= 5)"""


def _flags(spark, d):
    t = transfers(spark, d).withColumnRenamed("receiver", "account")
    price = P.repeated(t, ["account", "kind", "discount", "fee"], 3).select(F.lit("REPEATED_LIMIT_PRICE").alias("kind"), "account", "n")
    return price.union(P.repeated(t, ["account"], 5, F.col("kind") == "R").select(F.lit("REPEATED_CONFIRMED_CANCEL"), "account", "n"))


@query("a6_day_summary", f"""
with w as (select * from transfers where ts > timestamp '2000-01-01' and ts <= timestamp '2000-01-31'), {_FLAGS}
select (select count(*) from w) as observed, (select count(*) from w where result = 'F') as classified, (select count(*) from w where result = 'O' and kind = 'N') as excluded,
  (select count(*) from w where result = 'O' and kind <> 'N') as unclassified, (select count(distinct tx_hash) from w where result = 'F') as exchange_txs, (select count(distinct receiver) from w where result = 'F') as wallets,
  (select cast(sum(amount) as double) from w where kind = 'A') as sold, (select cast(sum(amount) as double) from w where kind = 'R') as bought,
  (select count(distinct account) from flags where kind = 'REPEATED_LIMIT_PRICE') as repeated_price_wallets, (select count(distinct account) from flags where kind = 'REPEATED_CONFIRMED_CANCEL') as cancel_wallets""")
def _(spark, d):
    w = transfers(spark, d, until="2000-01-31").where("ts > timestamp_ntz'2000-01-01' and ts <= timestamp_ntz'2000-01-31'")  # open at the start
    done = F.col("result") == "F"
    one = w.agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(done).alias("classified"), F.count_if(~done & (F.col("kind") == "N")).alias("excluded"),
        F.count_if(~done & (F.col("kind") != "N")).alias("unclassified"), F.countDistinct(F.when(done, F.col("tx_hash"))).alias("exchange_txs"),
        F.countDistinct(F.when(done, F.col("receiver"))).alias("wallets"), F.sum(F.when(F.col("kind") == "A", F.col("amount"))).cast("double").alias("sold"),
        F.sum(F.when(F.col("kind") == "R", F.col("amount"))).cast("double").alias("bought"),
    )
    f = _flags(spark, d).agg(
        F.countDistinct(F.when(F.col("kind") == "REPEATED_LIMIT_PRICE", F.col("account"))).alias("repeated_price_wallets"),
        F.countDistinct(F.when(F.col("kind") == "REPEATED_CONFIRMED_CANCEL", F.col("account"))).alias("cancel_wallets"),
    )
    return one.crossJoin(F.broadcast(f))  # one row each


@query("a7_top_findings", f"with {_FLAGS} select * from flags order by n desc, account, kind limit 24")
def _(spark, d):
    return _flags(spark, d).orderBy(F.col("n").desc(), "account", "kind").limit(24)


@query("a8_execution_totals", """
select cast(ts as date) as day, count(*) as transactions, count(*) filter (result = 'F') as execution_transactions, count(*) filter (result = 'F' and kind <> 'N') as order_book_fills,
  count(*) filter (result = 'F' and kind = 'R') as partial_fills, count(*) filter (result = 'F' and kind = 'N') as amm_swaps,
  cast(coalesce(sum(amount) filter (result = 'F' and kind <> 'N'), 0) as double) as order_book, cast(coalesce(sum(amount) filter (result = 'F' and kind = 'N'), 0) as double) as amm
from transfers group by 1""")
def _(spark, d):
    fill, amm = F.col("result") == "F", F.col("kind") == "N"
    return transfers(spark, d).groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("transactions"), F.count_if(fill).alias("execution_transactions"), F.count_if(fill & ~amm).alias("order_book_fills"),
        F.count_if(fill & (F.col("kind") == "R")).alias("partial_fills"), F.count_if(fill & amm).alias("amm_swaps"),
        R.total("amount", fill & ~amm).alias("order_book"), R.total("amount", fill & amm).alias("amm"),
    )


@query("a9_daily_wallet_totals", """
with w as (
  select cast(ts as date) as day, sender as account, 0.00 as received, case when kind = 'A' then amount else 0 end as sent, (kind = 'R')::int as offers, (kind = 'R' and result = 'F')::int as cancels, (kind = 'A')::int as legs from transfers where kind in ('A', 'R')
  union all select cast(ts as date), receiver, amount, 0, 0, 0, 1 from transfers where kind = 'A'),
f as (select day, account, count(*) as flags from (select cast(ts as date) as day, sender as account from transfers where amount >= 90000 union all select cast(ts as date), receiver from transfers where amount >= 90000 and kind = 'A' and receiver <> sender) group by 1, 2),
g as (select day, account, cast(sum(received) as double) as received, cast(sum(sent) as double) as sent, sum(offers)::bigint as offers, sum(cancels)::bigint as cancels, sum(legs)::bigint as legs from w group by 1, 2)
select g.*, coalesce(flags, 0) as flags from g left join f using (day, account)""")
def _(spark, d):
    t = transfers(spark, d, ["sender", "receiver", "amount", "ts", "kind", "result"]).withColumn("day", F.to_date("ts"))
    flags = t.where("amount >= 90000").select("day", F.col("sender").alias("account"), F.when(F.col("kind") == "A", F.col("receiver")).alias("to"))
    offer = F.col("kind") == "R"
    return R.daily_wallets(t, flags, "day", "sender", "receiver", "amount", F.col("kind") == "A", offer, offer & (F.col("result") == "F"))


@query("a10_run_status_counts", """
select o_orderpriority as run, count(*) as total, count(*) filter (o_orderstatus = 'F') as complete, count(*) filter (o_orderstatus = 'P') as failed from orders group by 1""", views=False)
def _(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "F").alias("complete"), F.count_if(s == "P").alias("failed"))


@query("a11_distinct_in_window", """
select count(distinct tx_hash) as n from transfers t where ts between timestamp '1998-01-01' and timestamp '1999-01-01' and exists (select 1 from supplier where s_suppkey = t.receiver and s_acctbal > 5000)""")
def _(spark, d):
    t = transfers(spark, d, until="1999-01-01").where("ts between timestamp_ntz'1998-01-01' and timestamp_ntz'1999-01-01'")
    watched = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("receiver"))
    return t.join(watched, "receiver", "left_semi").agg(F.countDistinct("tx_hash").alias("n"))


_STATUS = "case o_orderstatus when 'F' then 'COMPLETE' when 'P' then 'TRUNCATED' when 'O' then case when o_custkey % 5 = 0 then null when o_custkey % 5 = 1 then 'UNPROVEN' when o_custkey % 5 = 2 then 'NEW' else 'FAILED' end end"


@query("a12_sealable", f"""
with s as (select o_orderpriority || '/' || (o_custkey % 50) as run, coalesce({_STATUS}, 'FAILED') as st, o_totalprice > 20000 as ok from orders)
select run, count(*) as target_wallets, count(*) filter (st = 'COMPLETE' and ok) as complete_wallets, count(*) filter (st = 'FAILED') as failed_wallets, count(*) filter (st = 'TRUNCATED') as truncated_wallets,
  count(*) filter (st = 'UNPROVEN') as unproven_wallets, count(*) filter (st = 'COMPLETE' and not ok) as unproven_start_wallets, count(*) filter (st = 'NEW') as unknown_status_wallets,
  count(*) filter (st = 'COMPLETE' and ok) = count(*) as full_window_complete from s group by 1""", views=False)
def _(spark, d):
    o = table(spark, d, "orders").select(F.expr("concat(o_orderpriority, '/', o_custkey % 50)").alias("run"), F.expr(_STATUS).alias("st"), (F.col("o_totalprice") > 20000).alias("ok"))
    return R.sealable(o, ["run"], "st", F.col("ok"))


@query("a13_coverage_rollup", f"""
with c as (select o_custkey as k, min(coalesce({_STATUS}, 'FAILED')) as st from orders where o_custkey % 3 > 0 group by 1)
select count(*) as target, count(*) filter (st = 'COMPLETE') as proven, count(*) filter (st = 'FAILED') as failed, count(*) filter (coalesce(st, 'UNPROVEN') not in ('COMPLETE', 'FAILED')) as unproven,
  count(*) filter (st = 'COMPLETE') = count(*) as complete from customer left join c on k = c_custkey""", views=False)
def _(spark, d):
    o = table(spark, d, "orders").where("o_custkey % 3 > 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.expr(f"coalesce({_STATUS}, 'FAILED')")).alias("st"))
    return R.coverage(table(spark, d, "customer"), o, "c_custkey", "st", F.lit(True))


@query("a14_failures_by_cause", """
select o_orderpriority as cause, count(*) as n, array_to_string(list_sort(list(distinct o_custkey)), ',') as addresses, max(o_custkey % 4) as attempts from orders where o_orderstatus = 'P' group by 1""", views=False)
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("cause"), F.col("o_custkey").alias("k"), (F.col("o_custkey") % 4).alias("a"))
    return R.failures(o, "cause", "k", "a").withColumn("addresses", F.array_join(F.col("addresses").cast("array<string>"), ","))


@query("a15_family_shares", "select type as family, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 1)::double as pct from activity group by 1")
def _(spark, d):
    return R.family_shares(activity(spark, d).withColumnRenamed("type", "family"), "family")


@query("a16_daily_increments", """
select cast(ts as date) as day, cast(coalesce(sum(value) filter (type = 'purchase'), 0) as double) as volume, count(*) as tx from activity group by 1""")
def _(spark, d):
    return activity(spark, d).groupBy(F.to_date("ts").alias("day")).agg(R.total("value", F.col("type") == "purchase").alias("volume"), F.count(F.lit(1)).alias("tx"))


@query("a17_volume_sample", """
select count(*) as n, cast(sum(value) as double) as volume, min(cast(ts as date)) as first_day, max(cast(ts as date)) as last_day, greatest(1, date_diff('day', min(cast(ts as date)), max(cast(ts as date)))) as span_days
from activity where type in ('purchase', 'click') and value > 0""")
def _(spark, d):
    a = activity(spark, d).where("type in ('purchase', 'click') and value > 0")
    day = F.to_date("ts")
    return a.agg(F.count(F.lit(1)).alias("n"), R.total("value").alias("volume"), F.min(day).alias("first_day"), F.max(day).alias("last_day")).withColumn(
        "span_days", F.greatest(F.lit(1), F.date_diff("last_day", "first_day"))
    )


@query("a23_ledger_volume", """
with v as (select type, account, sum(value) as volume from activity group by all having sum(value) > 0)
select type, count(*) as tokens, cast(sum(volume) as double) as volume, cast(min(volume) as double) as smallest, array_to_string(list(account order by volume desc, account)[1:5], ',') as top5, count(*) < 200 as short_sample
from v group by 1""")
def _(spark, d):
    v = activity(spark, d).groupBy("type", "account").agg(F.sum("value").alias("volume")).where("volume > 0")
    totals = v.groupBy("type").agg(F.count(F.lit(1)).alias("tokens"), R.total("volume").alias("volume"), F.min("volume").cast("double").alias("smallest"))
    top = R.leaders(v, ["type"], [F.col("volume").desc(), F.col("account")], "account", 5)
    top = top.select(F.col("type").alias("_t"), F.array_join("leaders", ",").alias("top5"))
    return totals.join(top, F.col("type").eqNullSafe(F.col("_t"))).drop("_t").withColumn("short_sample", F.col("tokens") < 200)


@query("a24_adapter_health", """
with t as (select type, sum(value) filter (ts >= timestamp '2024-01-30') as total24h, sum(value) filter (ts >= timestamp '2024-01-24') as total7d, sum(value) as total30d, 0 as silent from activity group by 1),
x as (select type, cast(total24h as double) as total24h, cast(total7d as double) / 7 as trailing_mean from t)
select type, trailing_mean, total24h / trailing_mean as ratio, false as partial, total24h > 0 as reported, total24h / trailing_mean >= 0.20 as plausible from x""")
def _(spark, d):
    w = lambda since: F.sum(F.when(F.col("ts") >= F.lit(since).cast("timestamp_ntz"), F.col("value"))).cast("double")
    t = activity(spark, d).groupBy("type").agg(w("2024-01-30").alias("total24h"), w("2024-01-24").alias("total7d"), F.sum("value").cast("double").alias("total30d"), F.lit(0).alias("silent"))
    return R.adapter_health(t, ["type"])


@query("a25_absorber_totals", """
select n_regionkey as region, cast(sum(amount) as double) as total, count(*) as n, string_agg(distinct s_name || ' x' || m, ', ' order by s_name || ' x' || m) as names from (
  select n_regionkey, amount, s_name, count(*) over (partition by s_suppkey) as m from transfers join supplier on receiver = s_suppkey join nation on s_nationkey = n_nationkey
  where regexp_matches(s_name, '#0000000[0-4]\\d')) group by 1""")
def _(spark, d):
    s = table(spark, d, "supplier").where(F.col("s_name").rlike(r"#0000000[0-4]\d")).join(F.broadcast(table(spark, d, "nation")), F.expr("s_nationkey = n_nationkey"))  # 25 rows
    per = transfers(spark, d).groupBy(F.col("receiver").alias("s_suppkey")).agg(F.sum("amount").alias("a"), F.count(F.lit(1)).alias("m"))
    j = per.join(s, "s_suppkey")
    names = F.array_join(F.array_sort(F.collect_set(F.concat("s_name", F.lit(" x"), F.col("m").cast("string")))), ", ")
    return j.groupBy(F.col("n_regionkey").alias("region")).agg(F.sum("a").cast("double").alias("total"), F.sum("m").alias("n"), names.alias("names"))


@query("a26_roster_union", """
with u as (
  select c_custkey as address, c_name as name, case when c_custkey % 2 = 0 then c_mktsegment end as segment, 0 as rank, 'report' as source from customer where c_acctbal > 0
  union all select s_suppkey, s_name, null, 1, 'wall' from supplier
  union all select c_custkey, null, c_mktsegment, 2, 'registry' from customer where c_custkey % 3 = 0)
select address, first(name order by rank) filter (name is not null) as name, first(segment order by rank) filter (segment is not null) as segment,
  array_to_string(list_sort(list(distinct source)), ',') as sources, coalesce(bool_or(segment is not null), false) as identified, coalesce(first(name order by rank) filter (name is not null), cast(address as varchar)) as label,
  case when address % 11 = 0 then 'REJECTED' else 'TARGET' end as state from u group by 1""", views=False)
def _(spark, d):
    c, s, none = table(spark, d, "customer"), table(spark, d, "supplier"), F.lit(None).cast("string")
    report = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("address"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    wall = s.select(F.col("s_suppkey").alias("address"), F.col("s_name").alias("name"), none.alias("segment"))
    registry = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("address"), none.alias("name"), F.col("c_mktsegment").alias("segment"))
    sources = [("report", report), ("wall", wall), ("registry", registry)]
    label = F.coalesce("name", F.col("address").cast("string"))
    targets, rejected = M.roster(sources, "address", ["name", "segment"], F.col("address") % 11 != 0, F.col("segment").isNotNull(), label)
    both = targets.withColumn("state", F.lit("TARGET")).unionByName(rejected.withColumn("state", F.lit("REJECTED")))
    return both.withColumn("sources", F.array_join("sources", ","))


@query("a27_storage_inventory", """
with f as (select cast(ts as date) as day, sum(quantity) as bytes, count(*) as rows from transfers group by 1)
select year(day) as grp, count(*) as files, cast(sum(bytes) as double) as bytes, cast(max(bytes) as double) as largest,
  case when sum(bytes) >= 240000 then 'CRITICAL' when sum(bytes) >= 200000 then 'WARNING' else 'OK' end as level from f group by 1""")
def _(spark, d):
    f = transfers(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.sum("quantity").alias("bytes"))
    g = f.groupBy(F.year("day").alias("grp")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("b"), F.max("bytes").cast("double").alias("largest"))
    return g.select("grp", "files", F.col("b").cast("double").alias("bytes"), "largest", F.when(F.col("b") >= 240000, "CRITICAL").when(F.col("b") >= 200000, "WARNING").otherwise("OK").alias("level"))


@query("a28_retention_plan", """
with p as (select case when tx_index = 1 then 'KEEP_PROOF' when ts >= timestamp '2001-01-01' then 'KEEP_RECENT' when amount > 90000 then 'KEEP_FLAGGED' else 'ARCHIVE_CANDIDATE' end as action, amount from transfers)
select action, count(*) as n, cast(sum(amount) as double) as total from p group by 1""")
def _(spark, d):
    action = R.retention(F.col("ts"), F.lit("2001-01-01").cast("timestamp_ntz"), F.col("tx_index") == 1, F.col("amount") > 90000)
    return transfers(spark, d).groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))


@query("a29_observed_range", """
select min(ledger) as first_ledger, max(ledger) as last_ledger, count(*) as counted, count(*) filter (tag % 10 = 0) as unindexed from transfers""")
def _(spark, d):
    return transfers(spark, d).agg(F.min("ledger").alias("first_ledger"), F.max("ledger").alias("last_ledger"), F.count(F.lit(1)).alias("counted"), F.count_if(F.col("tag") % 10 == 0).alias("unindexed"))


@query("i13_volume_decision", """
with t as (select account, cast(coalesce(sum(value) filter (type = 'purchase'), 0) as double) as ledger, cast(sum(value) filter (type = 'click') as double) as agg from activity group by 1),
v as (select *, coalesce(agg, 0) > 100 as plausible from t)
select account, ledger, agg, plausible, case when ledger > 0 then ledger when plausible and agg > 0 then agg end as volume,
  case when ledger > 0 then 'LEDGER' when plausible and agg > 0 then 'AGGREGATOR' else 'UNAVAILABLE' end as source,
  coalesce(case when least(ledger, agg) > 0 then greatest(ledger, agg) / least(ledger, agg) > 5 end, false) as disagree from v""")
def _(spark, d):
    t = activity(spark, d).groupBy("account").agg(R.total("value", F.col("type") == "purchase").alias("ledger"), F.sum(F.when(F.col("type") == "click", F.col("value"))).cast("double").alias("agg"))
    return R.volume_decision(t.withColumn("plausible", F.coalesce("agg", F.lit(0.0)) > 100), "ledger", "agg", "plausible")
