"""Patterns on the adapter views. Thresholds fit the amounts of these tables; tests keep the defaults."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import patterns as P
from ..sources.tables import activity, sightings, table, transfers
from .registry import query

LOW, HIGH, TOTAL = 10_000, 100_000, 100_000


def _band(spark, d, *more):
    return P.mid_band(transfers(spark, d, ["tx_hash", "sender", "receiver", "amount", *more]), "amount", LOW, HIGH)


@query("p1_repeated_limit_price", """
select receiver as account, kind as side, discount, fee, count(*) as n from transfers group by all having count(*) >= 3""")
def _(spark, d):
    q = transfers(spark, d).select(F.col("receiver").alias("account"), F.col("kind").alias("side"), "discount", "fee")
    return P.repeated(q, ["account", "side", "discount", "fee"], 3)


@query("p2_repeated_confirmed_cancel", """
select receiver as account, count(*) as n from transfers where kind = 'R' group by 1 having count(*) >= 5""")
def _(spark, d):
    return P.repeated(transfers(spark, d).withColumnRenamed("receiver", "account"), ["account"], 5, F.col("kind") == "R")


@query("p3_regular_interval", """
with g as (
  select sender, receiver, count(*) over (partition by sender, receiver) as n,
    epoch(ts)::bigint - lag(epoch(ts)::bigint) over (partition by sender, receiver order by ledger, tx_index nulls last, tx_hash) as gap
  from transfers
), m as (
  select sender, receiver, any_value(n) as n, list_sort(list(gap) filter (gap is not null)) as gaps from g where n >= 3 group by all
), x as (select *, gaps[len(gaps) // 2 + 1] as mid from m)
select sender, receiver, mid as interval_seconds, n from x
where mid >= 10 and len(list_filter(gaps, lambda g: abs(g - mid) > greatest(2, mid * 0.4))) = 0""")
def _(spark, d):
    t = transfers(spark, d)
    return P.regular_intervals(t, ["sender", "receiver"], [F.col("ledger"), F.col("tx_index").asc_nulls_last(), F.col("tx_hash")], "ts", at_least=3, tolerance=0.4)


@query("p4_repeated_route", f"""
select sender, receiver, count(*) as n, cast(sum(amount) as double) as total from transfers
where amount >= {LOW} and amount < {HIGH} group by 1, 2 having count(*) >= 3 and sum(amount) >= {TOTAL}""")
def _(spark, d):
    g = P.flow_groups(_band(spark, d), "sender", "receiver", "amount", 3, TOTAL)["route"]
    return g.withColumn("total", F.col("total").cast("double"))


@query("p5_fan_out", f"""
select sender, count(*) as n, cast(sum(amount) as double) as total, count(distinct receiver) as others from transfers
where amount >= {LOW} and amount < {HIGH} group by 1 having count(*) >= 3 and sum(amount) >= {TOTAL} and count(distinct receiver) >= 2""")
def _(spark, d):
    g = P.flow_groups(_band(spark, d), "sender", "receiver", "amount", 3, TOTAL)["fan_out"]
    return g.withColumn("total", F.col("total").cast("double"))


@query("p6_fan_in", f"""
select receiver, count(*) as n, cast(sum(amount) as double) as total, count(distinct sender) as others from transfers
where amount >= {LOW} and amount < {HIGH} group by 1 having count(*) >= 3 and sum(amount) >= {TOTAL} and count(distinct sender) >= 2""")
def _(spark, d):
    g = P.flow_groups(_band(spark, d), "sender", "receiver", "amount", 3, TOTAL)["fan_in"]
    return g.withColumn("total", F.col("total").cast("double"))


@query("p7_clustered_flow", f"""
with band as (select * from transfers where amount >= {LOW} and amount < {HIGH}),
r as (select sender, receiver from band group by 1, 2 having count(*) >= 3 and sum(amount) >= {TOTAL}),
o as (select sender from band group by 1 having count(*) >= 3 and sum(amount) >= {TOTAL} and count(distinct receiver) >= 2),
i as (select receiver from band group by 1 having count(*) >= 3 and sum(amount) >= {TOTAL} and count(distinct sender) >= 2)
select kind, count(*) as n, cast(sum(amount) as double) as total from band b
where exists (select 1 from r where r.sender = b.sender and r.receiver = b.receiver) or sender in (select sender from o) or receiver in (select receiver from i)
group by 1""")
def _(spark, d):
    c = P.clustered(_band(spark, d, "kind"), "tx_hash", "sender", "receiver", "amount", 3, TOTAL)
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))


@query("p7_top_patterns", f"""
with band as (select * from transfers where amount >= {LOW} and amount < {HIGH}),
g as (
  select 'REPEATED_ROUTE' as kind, sender as a, receiver as b, count(*) as n, sum(amount) as total from band group by all having count(*) >= 3 and sum(amount) >= {TOTAL}
  union all select 'FAN_OUT', sender, null, count(*), sum(amount) from band group by sender having count(*) >= 3 and sum(amount) >= {TOTAL} and count(distinct receiver) >= 2
  union all select 'FAN_IN', receiver, null, count(*), sum(amount) from band group by receiver having count(*) >= 3 and sum(amount) >= {TOTAL} and count(distinct sender) >= 2
)
select kind, a, b, n, cast(total as double) as total from g order by total desc, kind, a, b nulls last limit 12""")
def _(spark, d):
    g = P.flow_groups(_band(spark, d), "sender", "receiver", "amount", 3, TOTAL)
    none = F.lit(None).cast("long").alias("b")
    rows = (
        g["route"].select(F.lit("REPEATED_ROUTE").alias("kind"), F.col("sender").alias("a"), F.col("receiver").alias("b"), "n", "total")
        .union(g["fan_out"].select(F.lit("FAN_OUT"), "sender", none, "n", "total"))
        .union(g["fan_in"].select(F.lit("FAN_IN"), "receiver", none, "n", "total"))
    )
    top = rows.orderBy(F.col("total").desc(), "kind", "a", F.col("b").asc_nulls_last()).limit(12)
    return top.withColumn("total", F.col("total").cast("double"))


@query("p8_large_transfer_audit", """
select count(*) as raw, count(distinct tx_hash) as distinct_hashes, count(*) - count(distinct tx_hash) as duplicates, cast(sum(amount) as double) as raw_total
from sightings where amount >= 50000""")
def _(spark, d):
    s = sightings(spark, d).where("amount >= 50000")
    return s.agg(F.count(F.lit(1)).alias("raw"), F.countDistinct("tx_hash").alias("distinct_hashes"), F.sum("amount").cast("double").alias("raw_total")).withColumn(
        "duplicates", F.col("raw") - F.col("distinct_hashes")
    )


@query("p9_burst", """
with w as (select account, count(*) over (partition by account order by ts range between interval 1 hour preceding and current row) as c from activity)
select account, count(*) as n, case when count(*) < 4 then 0.0 else cast(max(c) as double) / count(*) end as burst from w group by 1""")
def _(spark, d):
    return P.burst_share(activity(spark, d), "account", "ts")


@query("p10_concentration", """
with c as (select sender, receiver, count(*) as c from transfers group by 1, 2)
select sender, sum(c)::bigint as n, cast(max(c) as double) / sum(c) as concentration from c group by 1""")
def _(spark, d):
    return P.concentration(transfers(spark, d, ["tx_hash", "sender", "receiver"]), "sender", "receiver")


@query("p11_coordination", """
with big as (select distinct cast(ts as date) as day, receiver from transfers where amount >= 95000),
days as (select distinct day from big order by day desc limit 30),
s as (select * from big where day in (select day from days))
select a.receiver as a, b.receiver as b, count(*) as n from s a join s b on a.day = b.day and a.receiver < b.receiver group by 1, 2 having count(*) >= 1""")
def _(spark, d):
    big = transfers(spark, d, ["ts", "receiver", "amount"]).where("amount >= 95000").select(F.to_date("ts").alias("day"), "receiver")
    return P.co_occurrence(big, "day", "receiver", 30, 1)


@query("p16_counterparty_qualification", """
with known as (select s_suppkey as node from supplier where s_suppkey % 7 = 0),
r as (
  select *, case when sender in (select node from known) then receiver else sender end as candidate
  from transfers where amount >= 20000 and (sender in (select node from known)) <> (receiver in (select node from known))
    and ts >= timestamp '1998-06-01' - interval 30000 hours and ts <= timestamp '1998-06-01' and (tag % 5 <> 0 or (sender in (select node from known)) = (tag % 2 = 0))
)
select candidate, count(distinct tx_hash) as n, count(distinct ledger) as ledgers, cast(sum(amount) as double) as total, cast(max(amount) as double) as largest from r
group by 1 having max(amount) >= 104000 or (count(distinct tx_hash) >= 2 and count(distinct ledger) >= 2 and sum(amount) >= 400000)
order by sum(amount) desc, candidate limit 5""")
def _(spark, d):
    known = table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("node"))
    # a fifth of the transfers was seen from one side only
    seen = F.when(F.col("tag") % 5 != 0, F.array("sender", "receiver")).otherwise(F.array(F.when(F.col("tag") % 2 == 0, F.col("sender")).otherwise(F.col("receiver"))))
    end = F.lit("1998-06-01").cast("timestamp_ntz")
    t = transfers(spark, d, ["tx_hash", "sender", "receiver", "amount", "ledger", "ts", "tag"], until="1998-06-01").withColumn("seen", seen)
    g = P.qualified(t, known, "sender", "receiver", "tx_hash", "amount", "ledger", 20000, 104000, 400000, high=1e11, ts="ts", end=end, hours=30000, observed_via="seen", fingerprint=["sender", "receiver", "amount", "ledger", "ts"])
    return g.withColumn("total", F.col("total").cast("double")).withColumn("largest", F.col("largest").cast("double"))


@query("p17_next_hop", """
with src as (
  select receiver as node, amount as received, ledger as at_ledger, ts as at_ts
  from (select *, row_number() over (partition by receiver order by amount desc, ledger, ts desc) as rn from transfers
    where result = 'F' and kind <> 'R' and receiver not in (select s_suppkey from supplier where s_suppkey % 7 = 0)) where rn = 1
)
select node, cast(received as double) as received, at_ledger, count(sender) as forwards, count(*) filter (amount >= 50000) as large_forwards,
  cast(sum(amount) as double) as forwarded,
  case when count(*) filter (amount >= 50000) > 0 then 'NEXT_HOP_FORWARDING_DETECTED' else 'UNPROVEN' end as status,
  case when count(*) filter (amount >= 50000) > 0 then 'HIGH' else 'LOW' end as confidence
from src left join (select * from transfers where result = 'F' and kind = 'A' and sender <> receiver) on sender = node and ledger > at_ledger and ts >= at_ts group by node, received, at_ledger""")
def _(spark, d):
    known = table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("node"))
    ok = F.col("result") == "F"
    g = P.next_hops(transfers(spark, d), "sender", "receiver", "amount", "ledger", "ts", 50000, known, ok & (F.col("kind") != "R"), ok & (F.col("kind") == "A"))
    return g.withColumn("received", F.col("received").cast("double")).withColumn("forwarded", F.col("forwarded").cast("double"))


@query("j9_largest_receipt", """
select receiver as node, cast(amount as double) as received, ledger as at_ledger
from (select *, row_number() over (partition by receiver order by amount desc, ledger) as rn from transfers) where rn = 1""")
def _(spark, d):
    r = P.largest_receipt(transfers(spark, d), "receiver", "amount", "ledger", "ts")
    return r.select("node", F.col("received").cast("double").alias("received"), "at_ledger")


@query("j15_reciprocal", """
with t as (select account, type as a, lead(type) over (partition by account order by ts, event_id) as b from activity),
c as (select account, a, b, count(*) as n from t where b is not null group by all)
select x.account, x.a, x.b, x.n, (case when x.a = x.b then x.n >= 2 else y.n is not null end) as reciprocal
from c x left join c y on x.account = y.account and x.a = y.b and x.b = y.a""")
def _(spark, d):
    w = W.partitionBy("account").orderBy("ts", "event_id")
    t = activity(spark, d).select("account", F.col("type").alias("a"), F.lead("type").over(w).alias("b")).where("b is not null")
    return P.reciprocal(t, ["account"], "a", "b")
