"""Joins, scans with keyset and membership, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import collection as C
from ..operators import joins as J
from ..operators import merge as M
from ..sources.tables import activity, sightings, table, transfers
from .registry import query


@query("j1_event_payload", """
select t.tx_hash, t.ledger, p.raw is null as missing, p.raw from transfers t left join (select tx_hash, 'raw-' || tag as raw from transfers where tag % 4 <> 0) p using (tx_hash)""")
def _(spark, d):
    t = transfers(spark, d)
    p = t.where("tag % 4 <> 0").select("tx_hash", F.concat(F.lit("raw-"), F.col("tag").cast("string")).alias("raw"))
    joined, _orphans = J.with_payload(t.select("tx_hash", "ledger"), p, "tx_hash")
    return joined.withColumn("missing", F.col("raw").isNull())


@query("j1_orphan_payloads", "select tx_hash from transfers where not (amount > 1000 and ledger % 2 = 0)")
def _(spark, d):
    t = transfers(spark, d)
    _joined, orphans = J.with_payload(t.where("amount > 1000 and ledger % 2 = 0").select("tx_hash"), t.select("tx_hash"), "tx_hash")
    return orphans


@query("j2_semi_membership", """
select receiver, count(*) as n from transfers t where exists (select 1 from supplier where s_suppkey = t.receiver and s_nationkey in (1, 2, 3)) group by 1""")
def _(spark, d):
    s = table(spark, d, "supplier").where(F.col("s_nationkey").isin(1, 2, 3)).select(F.col("s_suppkey").alias("receiver"))
    return transfers(spark, d, ["receiver"]).join(s, "receiver", "left_semi").groupBy("receiver").agg(F.count(F.lit(1)).alias("n"))


@query("j3_wallets_without_transactions", """
select c_custkey from customer where not exists (select 1 from transfers where sender = c_custkey and amount > 104000)""")
def _(spark, d):
    t = transfers(spark, d).where("amount > 104000").select(F.col("sender").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(t, "c_custkey", "left_anti")


@query("j4_content_conflicts", """
select distinct a.tx_hash from sightings a join transfers b using (tx_hash) where a.amount is distinct from b.amount or a.receiver is distinct from b.receiver""")
def _(spark, d):
    return M.upsert_conflicts(sightings(spark, d), transfers(spark, d), "tx_hash", ["amount", "receiver"]).distinct()


@query("j5_runs_wallets", """
select o_orderpriority as scan_id, c_mktsegment as segment, count(*) as wallets, count(distinct o_custkey) as distinct_wallets from orders join customer on o_custkey = c_custkey group by 1, 2""", views=False)
def _(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("o_orderpriority").alias("scan_id"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("wallets"), F.countDistinct("o_custkey").alias("distinct_wallets"))


@query("j6_day_payloads", """
select tx_hash, o_totalprice from transfers join orders on ledger = o_orderkey where ts >= timestamp '1999-03-01' and ts < timestamp '1999-03-08'""")
def _(spark, d):
    t = transfers(spark, d, until="1999-03-08").where("ts >= timestamp_ntz'1999-03-01' and ts < timestamp_ntz'1999-03-08'")
    return t.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("ledger"), "o_totalprice"), "ledger").select("tx_hash", "o_totalprice")


@query("j7_dimension_labels", """
select r_name as region, n_name as nation, count(*) as n, cast(sum(amount) as double) as total from transfers join supplier on receiver = s_suppkey
left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by 1, 2""")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("receiver"), "s_nationkey")
    per = transfers(spark, d).groupBy("receiver").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("t"))
    n = J.dimension(table(spark, d, "nation")).join(J.dimension(table(spark, d, "region")), F.expr("n_regionkey = r_regionkey"), "left")
    j = per.join(s, "receiver").join(n, F.expr("s_nationkey = n_nationkey"), "left")
    return j.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("n").alias("n"), F.sum("t").cast("double").alias("total"))


@query("j8_one_known_end", """
with k as (select s_suppkey as node from supplier where s_suppkey % 7 = 0)
select tx_hash, sender, receiver, sender in (select node from k) as known_a, receiver in (select node from k) as known_b from transfers
where (sender in (select node from k)) <> (receiver in (select node from k))""")
def _(spark, d):
    k = table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("node"))
    return J.members_differ(transfers(spark, d, ["tx_hash", "sender", "receiver"]).select("tx_hash", "sender", "receiver"), k, "node", "sender", "receiver")


@query("j10_confirmed_cancel", """
select o.sender, o.tx_hash, exists (select 1 from transfers x where x.sender = o.sender and x.tag = o.tag and x.kind = 'A') as confirmed from transfers o where o.kind = 'R'""")
def _(spark, d):
    t = transfers(spark, d)
    removed = t.where("kind = 'A'").select("sender", "tag").distinct().withColumn("_c", F.lit(True))
    return t.where("kind = 'R'").join(removed, ["sender", "tag"], "left").select("sender", "tx_hash", F.coalesce("_c", F.lit(False)).alias("confirmed"))


@query("j11_maker_legs", """
select tx_hash, sender from transfers t where kind = 'N' and exists (select 1 from transfers m where m.sender = t.sender and m.receiver = t.receiver and m.kind = 'A')""")
def _(spark, d):
    t = transfers(spark, d)
    return t.where("kind = 'N'").join(t.where("kind = 'A'").select("sender", "receiver"), ["sender", "receiver"], "left_semi").select("tx_hash", "sender")


@query("j12_as_of_baseline", """
select c_custkey, b.o_orderkey, epoch(b.o_orderdate)::bigint as at from customer left join (
  select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders where o_orderdate <= timestamp '1998-06-30') b
  on o_custkey = c_custkey and rn = 1""", views=False)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    b = J.as_of(o.withColumn("on", F.col("at.o_orderdate")), "c_custkey", "at", F.struct(F.lit("1998-06-30").cast("timestamp_ntz"), F.lit((1 << 63) - 1)), ["on"])
    j = table(spark, d, "customer").select("c_custkey").join(b, "c_custkey", "left")
    return j.select("c_custkey", F.col("at.o_orderkey").alias("o_orderkey"), F.unix_timestamp("on").alias("at"))


@query("j12_as_of_each", """
select e.event_id, p.value as last_price from (select * from activity where type = 'click') e
asof left join (select account, ts, value from activity where type = 'purchase') p on e.account = p.account and e.ts >= p.ts""")
def _(spark, d):
    a = activity(spark, d)
    clicks = a.where("type = 'click'").select("account", "ts", "event_id")
    prices = a.where("type = 'purchase'").select("account", F.col("ts").alias("priced"), F.col("value").alias("last_price"))
    return J.as_of_each(clicks, prices, "account", "ts", "priced", ["last_price"], F.to_date).select("event_id", "last_price")


@query("j13_newest_per_day", """
select day, tx_hash, ledger from (select cast(ts as date) as day, tx_hash, ledger, row_number() over (partition by cast(ts as date) order by ledger desc, tx_hash desc) as rn from transfers) where rn = 1""")
def _(spark, d):
    t = transfers(spark, d).select(F.to_date("ts").alias("day"), F.struct("ledger", "tx_hash").alias("v"))
    return J.newest_per(t, ["day"], "v").select("day", "v.tx_hash", "v.ledger")


_SAMPLES = """s as (select date_trunc('hour', ts) as sample, account % 5 as account, type as side, sum(value) as size from activity group by all),
o as (select sample, lag(sample) over (order by sample) as prev from (select distinct sample from s)),
g as (select sample, prev from o where epoch(sample) - epoch(prev) between 1 and 7200)"""


@query("j14_adjacent_quotes", f"""
with {_SAMPLES} select epoch(n.sample)::bigint as sample, n.account, n.side, cast(n.size - p.size as double) as increase from g join s n on n.sample = g.sample
join s p on p.sample = g.prev and p.account = n.account and p.side = n.side where n.size - p.size > 0""")
def _(spark, d):
    a = activity(spark, d).select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("sample"), (F.col("account") % 5).alias("account"), F.col("type").alias("side"), "value")
    found = J.adjacent_increase(a.withColumn("at", F.col("sample")), "sample", "at", ["account", "side"], "value", 7200)
    return found.select(F.unix_timestamp("sample").alias("sample"), "account", "side", F.col("increase").cast("double").alias("increase"))


@query("p19_visible_size_increase", f"""
with {_SAMPLES} select n.account, n.side, count(*) as increases, cast(sum(n.size - p.size) as double) as grown from g join s n on n.sample = g.sample
join s p on p.sample = g.prev and p.account = n.account and p.side = n.side where n.size - p.size > 0 group by 1, 2""")
def _(spark, d):
    a = activity(spark, d).select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("sample"), (F.col("account") % 5).alias("account"), F.col("type").alias("side"), "value")
    found = J.adjacent_increase(a.withColumn("at", F.col("sample")), "sample", "at", ["account", "side"], "value", 7200)
    return found.groupBy("account", "side").agg(F.count(F.lit(1)).alias("increases"), F.sum("increase").cast("double").alias("grown"))


@query("j16_set_equality", """
(select o_orderkey as k, 'left' as side from orders except all select l_orderkey, 'left' from lineitem)
union all (select distinct l_orderkey, 'right' from lineitem except all select o_orderkey, 'right' from orders)""", views=False)
def _(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return J.set_difference(a, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct())


@query("s1_bounded_history_walk", """
with w as (select sender, ledger, lag(ledger) over (partition by sender order by ts, ledger, tx_hash) as before from transfers where ledger between 1000 and 12000)
select sender, count(*) as rows, min(ledger) as first_ledger, max(ledger) as last_ledger, count(*) filter (before > ledger) as out_of_order from w group by 1""")
def _(spark, d):
    w = W.partitionBy("sender").orderBy("ts", "ledger", "tx_hash")
    t = transfers(spark, d).where("ledger between 1000 and 12000").withColumn("before", F.lag("ledger").over(w))
    return t.groupBy("sender").agg(F.count(F.lit(1)).alias("rows"), F.min("ledger").alias("first_ledger"), F.max("ledger").alias("last_ledger"), F.count_if(F.col("before") > F.col("ledger")).alias("out_of_order"))


@query("s2_ledger_scan", """
select ledger, count(*) as txs, count(distinct tx_index) = count(*) as whole, max(tx_index) - min(tx_index) + 1 = count(*) as contiguous from transfers group by 1""")
def _(spark, d):
    return transfers(spark, d).groupBy("ledger").agg(F.count(F.lit(1)).alias("txs"), F.countDistinct("tx_index").alias("k"), F.min("tx_index").alias("a"), F.max("tx_index").alias("b")).select(
        "ledger", "txs", (F.col("k") == F.col("txs")).alias("whole"), (F.col("b") - F.col("a") + 1 == F.col("txs")).alias("contiguous")
    )


@query("s2_cross_checked_scan", """
with l as (select o_orderkey as ledger, case when o_orderkey % 41 > 0 then 'h' || o_orderkey end as own, 'h' || (o_orderkey - case when o_orderkey % 43 = 0 then 2 else 1 end) as parent, case when o_orderkey % 47 > 0 then 'h' || o_orderkey end as second, o_orderkey % 53 = 0 as header from orders),
g as (select ledger, count(*) as n, count(distinct tx_index) as u, min(tx_index) as lo, max(tx_index) as hi, bool_or(tag % 59 = 0) as unlisted from transfers group by 1)
select l.ledger, coalesce(n, 0) as txs, case when l.own is null or second is null then 'LEDGER_UNPROVEN' when header then 'HEADER_MISMATCH' when p.ledger is not null and l.parent is distinct from p.own then 'CHAIN_MISMATCH'
  when unlisted then 'TRANSACTION_SET_MISMATCH' when n is not null and not (lo = 1 and hi = n and u = n) then 'TRANSACTION_INDEX_GAP' end as problem
from l left join g using (ledger) left join (select ledger, own from l) p on p.ledger = l.ledger - 1""")
def _(spark, d):
    """Orders are ledgers; some answers lack a hash, name another parent or header, or list other transactions."""
    o = table(spark, d, "orders")
    h = "concat('h', o_orderkey)"
    expanded = o.selectExpr("o_orderkey as ledger", f"if(o_orderkey % 41 > 0, {h}, null) as hash", "concat('h', o_orderkey - if(o_orderkey % 43 = 0, 2, 1)) as parent", "o_orderdate as header")
    listed = o.selectExpr("o_orderkey as ledger", f"if(o_orderkey % 47 > 0, {h}, null) as hash", "if(o_orderkey % 53 = 0, null, o_orderdate) as header")
    t = transfers(spark, d, ["tx_hash", "ledger", "tx_index", "tag"])
    rows = t.select("ledger", "tx_hash", (F.col("tx_index") - 1).alias("index"))
    return C.ledger_scan(expanded, listed, rows, t.where("tag % 59 > 0").select("ledger", "tx_hash"))


@query("s3_order_book", """
with b as (select receiver, kind as side, discount as price, quantity, row_number() over (partition by receiver, kind order by discount, tx_hash) as rn from transfers where kind in ('A', 'R'))
select receiver, side, count(*) as offers, cast(min(price) as double) as best, cast(sum(quantity) as double) as depth from b where rn <= 200 group by 1, 2""")
def _(spark, d):
    w = W.partitionBy("receiver", "kind").orderBy("discount", "tx_hash")
    b = transfers(spark, d).where("kind in ('A', 'R')").withColumn("rn", F.row_number().over(w)).where("rn <= 200")
    return b.groupBy("receiver", F.col("kind").alias("side")).agg(F.count(F.lit(1)).alias("offers"), F.min("discount").cast("double").alias("best"), F.sum("quantity").cast("double").alias("depth"))


@query("s3_proven_books", """
with b as (select ledger, kind as side, count(*) as offers from transfers where kind in ('A', 'R') group by 1, 2)
select ledger, side, offers, case when ledger % 29 = 0 or ledger % 31 = 0 or ledger % 37 = 0 or offers > 3 then 'UNPROVEN_BOOK' end as problem from b""")
def _(spark, d):
    """Sides of a ledger's book; some answers name another ledger, deny being validated or have no hash."""
    b = transfers(spark, d, ["ledger", "kind"]).where("kind in ('A', 'R')").groupBy("ledger", F.col("kind").alias("side")).agg(F.count(F.lit(1)).alias("offers"))
    said = F.expr("case when ledger % 29 = 0 then 'other' when ledger % 37 > 0 then concat('h', ledger) end")
    validated = F.expr("case when ledger % 31 = 0 then false when ledger % 2 = 0 then true end")
    problem = C.book_problem(said, F.col("ledger"), validated, F.col("offers"), F.concat(F.lit("h"), "ledger"), F.col("ledger"), 3)
    return b.withColumn("problem", problem)


@query("s4_valid_tickers", """
select event_id, cast(value as double) as price from activity where value > 0 and value * 0.99 <= value * 1.01 and epoch(timestamp '2024-01-15') - epoch(ts) between -10 and 86400""")
def _(spark, d):
    # a second's fraction counts: compare in micros
    exact = (F.unix_micros(F.lit("2024-01-15").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return activity(spark, d).where((F.col("value") > 0) & (F.col("value") * 0.99 <= F.col("value") * 1.01) & exact.between(-10, 86400)).select("event_id", F.col("value").cast("double").alias("price"))


@query("s6_wallet_page", """
select tx_hash, ledger from transfers where receiver = 7 and ts between timestamp '1996-01-01' and timestamp '2000-01-01' and ledger <= 14000 and tx_hash > '10' order by tx_hash limit 200""")
def _(spark, d):
    t = transfers(spark, d, until="2000-01-01").where("receiver = 7 and ts between timestamp_ntz'1996-01-01' and timestamp_ntz'2000-01-01' and ledger <= 14000 and tx_hash > '10'")
    return t.orderBy("tx_hash").limit(200).select("tx_hash", "ledger")


@query("s7_run_page", """
select tx_hash, array_to_string(list_sort(list(distinct receiver)), ',') as observers from sightings where ts >= timestamp '1999-01-01' and receiver in (select s_suppkey from supplier where s_acctbal > 0)
group by 1 order by 1 limit 5000""")
def _(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("receiver"))
    t = sightings(spark, d).where("ts >= timestamp_ntz'1999-01-01'").join(s, "receiver", "left_semi")
    return t.groupBy("tx_hash").agg(F.array_join(F.array_sort(F.collect_set("receiver")).cast("array<string>"), ",").alias("observers")).orderBy("tx_hash").limit(5000)


@query("s8_day_window", """
with w as (select * from transfers where ts between timestamp '1998-01-01' and timestamp '1998-01-31'),
o as (select tx_hash, array_to_string(list_sort(list(distinct receiver)), ',') as observers from sightings group by 1)
select tx_hash, epoch(ts)::bigint as close, cast(case when tag % 2 = 0 then amount + 1 else amount end as double) as amount, observers from w join o using (tx_hash)""")
def _(spark, d):
    w = transfers(spark, d, ["tx_hash", "ts", "receiver", "tag", "amount"], "1998-01-31").where("ts between timestamp_ntz'1998-01-01' and timestamp_ntz'1998-01-31'")
    fresh = w.where("tag % 2 = 0").withColumn("amount", (F.col("amount") + 1).cast("decimal(18,2)"))
    o = sightings(spark, d).join(w.select("tx_hash"), "tx_hash", "left_semi").groupBy("tx_hash").agg(F.array_join(F.array_sort(F.collect_set("receiver")).cast("array<string>"), ",").alias("observers"))
    rows = M.upserted(w, fresh, "tx_hash").join(o, "tx_hash", "left")
    return rows.orderBy("ts", "tx_hash").select("tx_hash", F.unix_timestamp("ts").alias("close"), F.col("amount").cast("double").alias("amount"), "observers")


@query("s9_report_catalog", """
select cast(o_orderdate as date) as day, o_orderkey as id from orders order by o_orderdate desc, o_orderkey desc limit 50 offset 50""", views=False)
def _(spark, d):
    o = table(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return o.offset(50).limit(50).select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"))


@query("s10_daily_klines", """
select cast(ts as date) as day, cast(sum(quantity) as double) as base, cast(sum(amount) as double) as quote, count(*) as trades from transfers group by 1 order by 1 desc limit 366""")
def _(spark, d):
    k = transfers(spark, d, ["ts", "amount", "quantity"]).groupBy(F.to_date("ts").alias("day")).agg(F.sum("quantity").cast("double").alias("base"), F.sum("amount").cast("double").alias("quote"), F.count(F.lit(1)).alias("trades"))
    return k.orderBy(F.col("day").desc()).limit(366)


@query("set_union_parties", "select distinct sender as node from transfers union select receiver from transfers")
def _(spark, d):
    t = transfers(spark, d)
    return t.select(F.col("sender").alias("node")).union(t.select("receiver")).distinct()


@query("set_except_waiting", "select c_custkey as node from customer except select sender from transfers where amount > 90000")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("node")).subtract(transfers(spark, d).where("amount > 90000").select("sender"))


@query("set_intersect_parties", "select s_suppkey as node from supplier intersect select sender from transfers")
def _(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")).intersect(transfers(spark, d).select("sender"))


@query("p21_count_decrease_audit", """
with peak as (select tx_hash, receiver from sightings), cur as (select tx_hash, receiver from transfers where tag % 100 <> 0),
x as (select (select count(*) from peak) as peak_rows, (select count(distinct tx_hash) from peak) as peak_unique, (select count(*) from cur) as now_rows, (select count(distinct tx_hash) from cur) as now_unique,
  (select count(*) from (select distinct tx_hash from peak except select tx_hash from cur)) as lost)
select *, case when lost = 0 and now_rows < peak_rows and peak_rows > peak_unique then 'EXPECTED_HASH_DEDUPE' when lost = 0 then 'CANONICALIZATION_NO_UNIQUE_LOSS' else 'UNEXPLAINED_UNIQUE_ROW_CHANGE' end as verdict from x""")
def _(spark, d):
    peak = sightings(spark, d).select("tx_hash")
    cur = transfers(spark, d).where("tag % 100 <> 0").select("tx_hash")
    n = lambda df, a, b: df.agg(F.count(F.lit(1)).alias(a), F.countDistinct("tx_hash").alias(b))
    lost = peak.distinct().join(cur, "tx_hash", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    x = n(peak, "peak_rows", "peak_unique").crossJoin(n(cur, "now_rows", "now_unique")).crossJoin(lost)  # one row each
    v = F.when((F.col("lost") == 0) & (F.col("now_rows") < F.col("peak_rows")) & (F.col("peak_rows") > F.col("peak_unique")), "EXPECTED_HASH_DEDUPE").when(F.col("lost") == 0, "CANONICALIZATION_NO_UNIQUE_LOSS")
    return x.withColumn("verdict", v.otherwise("UNEXPLAINED_UNIQUE_ROW_CHANGE"))
