"""Daily series, drains, signing modes, escrow rollups, large moves, headlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collection as C
from ..operators import headlines as H
from ..operators import series as S
from ..shipping import shipped
from ..sources.tables import activity, table, transfers
from .registry import query

_KIND = "case type when 'signup' then 'LOCK' when 'purchase' then 'UNLOCK' when 'error' then 'CANCEL' end"
_ESC = f"e as (select event_id as k, account, ts, value, {_KIND} as kind from activity where type in ('signup', 'purchase', 'error'))"


def _escrows(spark, d):
    return activity(spark, d).where("type in ('signup', 'purchase', 'error')").select(F.col("event_id").alias("k"), "account", "ts", "value", F.expr(_KIND).alias("kind"))


def _lanes(keys, source="e"):
    return f"""select {keys}, count(*) filter (kind = 'LOCK') as locks, cast(coalesce(sum(value) filter (kind = 'LOCK'), 0) as double) as locked, count(*) filter (kind = 'UNLOCK') as unlocks,
  cast(coalesce(sum(value) filter (kind = 'UNLOCK'), 0) as double) as released, count(*) filter (kind = 'CANCEL') as cancels,
  first(k order by value desc, k desc) filter (kind <> 'CANCEL') as largest from {source} group by 1"""


@query("a18_escrow_lanes", f"with {_ESC} {_lanes('cast(ts as date) as day')}")
def _(spark, d):
    return S.escrow_lanes(_escrows(spark, d).withColumn("day", F.to_date("ts")), ["day"], "kind", "value", "k")


@query("a19_canonical_escrow", f"""
with {_ESC} , c as (select *, case when account % 10 = 9 then 'UNATTRIBUTED' when account % 3 = 0 then 'COHORT' else 'OTHER' end as cohort from e) {_lanes('cohort', 'c')}""")
def _(spark, d):
    a = F.col("account")
    c = F.when(a % 10 == 9, "UNATTRIBUTED").when(a % 3 == 0, "COHORT").otherwise("OTHER")
    return S.escrow_lanes(_escrows(spark, d).withColumn("cohort", c), ["cohort"], "kind", "value", "k")


@query("a20_escrow_by_owner", f"""
with {_ESC} , o as (select account, coalesce(sum(value) filter (kind = 'LOCK'), 0) as locked, coalesce(sum(value) filter (kind = 'UNLOCK'), 0) as released from e where account % 3 <> 0 group by 1)
select account, cast(locked as double) as locked, cast(released as double) as released from o where locked + released > 0 order by locked + released desc, account limit 25""")
def _(spark, d):
    s = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0))
    o = _escrows(spark, d).where("account % 3 <> 0").groupBy("account").agg(s("LOCK").alias("locked"), s("UNLOCK").alias("released")).where("locked + released > 0")
    o = o.orderBy((F.col("locked") + F.col("released")).desc(), "account").limit(25)
    return o.select("account", F.col("locked").cast("double").alias("locked"), F.col("released").cast("double").alias("released"))


@query("a21_escrow_position", """
with o as (select ledger, any_value(sender) as owner, min(amount) as amount, bool_or(kind = 'N') as foreign_asset from transfers where result = 'O' group by 1)
select cast(sum(amount) filter (not foreign_asset) as double) as locked, count(*) filter (not foreign_asset) as objects, count(distinct owner) filter (not foreign_asset) as owners, count(*) filter (foreign_asset) as other_assets from o""")
def _(spark, d):
    o = transfers(spark, d).where("result = 'O'").groupBy("ledger").agg(F.min("sender").alias("owner"), F.min("amount").alias("amount"), F.bool_or(F.col("kind") == "N").alias("x"))
    own = ~F.col("x")
    return o.agg(F.sum(F.when(own, F.col("amount"))).cast("double").alias("locked"), F.count_if(own).alias("objects"), F.countDistinct(F.when(own, F.col("owner"))).alias("owners"), F.count_if("x").alias("other_assets"))


@query("a21_escrow_position_answers", """
with o as (select sender, case when tag % 10 = 0 then receiver else sender end as owner, ledger, case when kind <> 'N' then amount end as amount from transfers where result = 'O'),
u as (select ledger, min(owner) as owner from o where owner = sender group by 1), v as (select u.ledger, u.owner, min(amount) as amount from u join o using (ledger, owner) where o.owner = o.sender group by 1, 2)
select cast(coalesce(sum(amount), 0) as double) as locked, count(amount) as objects, count(distinct case when amount is not null then owner end) as owners, count(*) filter (amount is null) as other_assets,
  (select count(*) from customer) as asked, (select count(*) from customer where c_custkey % 50 > 0) as answered, (select count(*) = 0 from customer where c_custkey % 50 = 0) as complete from v""")
def _(spark, d):
    """Open ledgers are objects, seen by each sender; a tenth name someone else as the owner, and some customers did not answer."""
    t = transfers(spark, d, ["sender", "receiver", "tag", "ledger", "amount", "kind", "result"]).where("result = 'O'")
    o = t.selectExpr("sender as asked", "if(tag % 10 = 0, receiver, sender) as owner", "ledger as key", "if(kind <> 'N', amount, null) as amount")
    asked = table(spark, d, "customer").selectExpr("c_custkey as address", "c_custkey % 50 > 0 as answered")
    return C.escrow_position(o, asked).withColumn("locked", F.col("locked").cast("double"))


_DAYS = """d as (select cast(ts as date) as day, sum(case type when 'purchase' then value when 'click' then -value end) as flow, cast(sum(value) filter (type = 'view') as double) as price,
  cast(coalesce(sum(value) filter (type = 'purchase'), 0) as double) as flow_in, cast(coalesce(sum(value) filter (type = 'click'), 0) as double) as flow_out from activity group by 1)"""


def _days(spark, d, keys=()):
    t = F.col("type")
    s = lambda k: F.sum(F.when(t == k, F.col("value")))
    return activity(spark, d).groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.sum(F.when(t == "purchase", F.col("value")).when(t == "click", -F.col("value"))).alias("flow"), s("view").cast("double").alias("price"),
        F.coalesce(s("purchase"), F.lit(0)).cast("double").alias("flow_in"), F.coalesce(s("click"), F.lit(0)).cast("double").alias("flow_out"),
    )


@query("a22_flow_series", f"with {_DAYS} select day, cast(flow as double) as net, flow_in, flow_out, price from d where day is not null and price > 0")
def _(spark, d):
    return _days(spark, d).where("day is not null and price > 0").select("day", F.col("flow").cast("double").alias("net"), "flow_in", "flow_out", "price")


_LEADLAG = """
with d as (select account % 4 as grp, cast(ts as date) as day, cast(sum(case type when 'purchase' then value when 'click' then -value end) as double) as f, cast(sum(value) filter (type = 'view') as double) as price from activity group by all),
c as (select *, row_number() over w - 1 as i, lag(price) over w as b from d window w as (partition by grp order by day)),
g as (select *, case when i > 0 then case when b > 0 then (price - b) / b * 100.0 else 0.0 end end as chg from c),
n as (select *, case when i >= 1 then lead(chg) over w end as nx, case when i >= 2 then lag(chg) over w end as pv from g window w as (partition by grp order by day)),
r as (select grp, count(*) as days, case when count(chg) >= 6 then corr(f, chg) end as same, case when count(nx) >= 6 then corr(f, nx) end as leads, case when count(pv) >= 6 then corr(f, pv) end as lags from n group by 1)
"""


def _relations(spark, d):
    a = activity(spark, d).withColumn("grp", F.col("account") % 4)
    t = F.col("type")
    days = a.groupBy("grp", F.to_date("ts").alias("day")).agg(
        F.sum(F.when(t == "purchase", F.col("value")).when(t == "click", -F.col("value"))).alias("flow"), F.sum(F.when(t == "view", F.col("value"))).cast("double").alias("price")
    )
    return S.lead_lag(days, ["grp"], "day", "flow", "price")


@query("p12_lead_lag", _LEADLAG + "select grp, days, round(same, 6) as same, round(leads, 6) as leads, round(lags, 6) as lags from r")
def _(spark, d):
    return _relations(spark, d).select("grp", "days", *(F.round(c, 6).alias(c) for c in ("same", "leads", "lags")))


@query("p13_verdict", _LEADLAG + """, v as (select grp, coalesce(abs(leads), -1) as l, coalesce(abs(same), -1) as s, coalesce(abs(lags), -1) as g from r), b as (select *, greatest(l, s, g) as m from v)
select grp, case when m >= 0.75 then 'strong' when m >= 0.55 then 'clear' when m >= 0.35 then 'weak' else 'none' end as strength,
  case when m < 0.35 then 'none' when l = m then 'leads' when s = m then 'same' else 'lags' end as relation from b""")
def _(spark, d):
    return S.verdict(_relations(spark, d)).select("grp", "strength", "relation")


_MONTHS = "m as (select sender as k, date_trunc('month', ts) as mon, cast(sum(amount) as double) as balance from transfers group by all)"


def _months(spark, d):
    return transfers(spark, d).groupBy(F.col("sender").alias("k"), F.date_trunc("month", F.col("ts").cast("timestamp")).alias("mon")).agg(F.sum("amount").cast("double").alias("balance"))


@query("p14_drain_state", f"""
with {_MONTHS}, g as (select k, count(*) as n, max(balance) as peak, arg_max(balance, mon) as last, case when k % 5 = 0 then 600000.0 end as lab from m group by k),
x as (select *, greatest(coalesce(lab, 0), peak) as expected from g)
select k, n, peak, last, expected, last / expected as ratio, case when expected < 10000 then case when last < 100000 then 'LIGHT' else 'OK' end when last / expected <= 0.05 then 'DRAINED' when last / expected <= 0.6 then 'BLEEDING'
  when last < 100000 and expected < 100000 then 'LIGHT' else 'OK' end as state from x""")
def _(spark, d):
    return S.drain(_months(spark, d), "k", "mon", "balance", F.when(F.col("k") % 5 == 0, F.lit(600000.0)), light=100_000)


@query("p14_running_peak", f"""
with {_MONTHS} select k, epoch(mon)::bigint as mon, balance, max(balance) over (partition by k order by mon) as peak, lag(balance) over (partition by k order by mon) as previous from m""")
def _(spark, d):
    return S.running_peak(_months(spark, d), "k", "mon", "balance").select("k", F.unix_timestamp("mon").alias("mon"), "balance", "peak", "previous")


@query("p15_signing_mode", """
with s as (select account, [0::bigint] || list(case when type in ('purchase', 'signup') then 1::bigint else 0 end order by ts, event_id) as seq, count(*) as n from activity group by 1),
f as (select account, n, list_reduce(seq, lambda a, x: a - a % 8 + [1, 2, 4, 3, 3, 6, 4, 6, 4, 5, 5, 14, 7, 6, 12, 7][a % 8 * 2 + x + 1]) as e from s)
select account, n, case when e % 8 >= 6 then 'multisig' when e % 8 >= 4 then 'single' end as mode, cast(e // 8 as int) as flips from f""")
def _(spark, d):
    mode = F.when(F.col("type").isin("purchase", "signup"), "multisig").otherwise("single")
    return S.mode_changes(activity(spark, d).withColumn("mode", mode), "account", ["ts", "event_id"], "mode", F.to_date("ts"))


@query("p18_large_move", """
with m as (select t.*, s.n_regionkey as from_entity, r.n_regionkey as to_entity, row_number() over (partition by cast(ts as date) order by
   (case when s.n_regionkey is null or r.n_regionkey is null or s.n_regionkey <> r.n_regionkey then 0 else 1 end), amount desc, tx_hash) as rn
  from transfers t left join customer on sender = c_custkey left join nation s on c_nationkey = s.n_nationkey left join supplier on receiver = s_suppkey left join nation r on s_nationkey = r.n_nationkey
  where kind <> 'N')
select cast(ts as date) as day, tx_hash, cast(amount as double) as amount, case when amount >= 100000 then 'CRITICAL' when amount >= 80000 then 'HIGH' else 'NORMAL' end as level,
  coalesce(from_entity <> to_entity, true) as cross_entity from m where rn = 1""")
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")  # 25 rows
    a = table(spark, d, "customer").join(F.broadcast(n), F.expr("c_nationkey = n_nationkey")).select(F.col("c_custkey").alias("sender"), F.col("n_regionkey").alias("fe"))
    b = table(spark, d, "supplier").join(F.broadcast(n), F.expr("s_nationkey = n_nationkey")).select(F.col("s_suppkey").alias("receiver"), F.col("n_regionkey").alias("te"))
    t = transfers(spark, d).where("kind <> 'N'").join(a, "sender", "left").join(b, "receiver", "left")
    cross = F.coalesce(F.col("fe") != F.col("te"), F.lit(True))
    # the best by an aggregate: cross-entity moves before others, then the largest
    best = F.min(F.struct((~cross).alias("same"), (-F.col("amount")).alias("minus"), "tx_hash")).alias("x")
    g = t.groupBy(F.to_date("ts").alias("day")).agg(best)
    amount = -F.col("x.minus")
    return g.select("day", "x.tx_hash", amount.cast("double").alias("amount"), F.when(amount >= 100000, "CRITICAL").when(amount >= 80000, "HIGH").otherwise("NORMAL").alias("level"), (~F.col("x.same")).alias("cross_entity"))


@query("r13_exact_headlines", """
select doc_id, left(lower(text), 80) as title from (select doc_id, text, row_number() over (partition by left(lower(text), 80) order by doc_id) as rn from documents) where rn = 1""", views=False)
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.substring(F.lower("text"), 1, 80).alias("title"))
    return t.groupBy("title").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "title")


def _titles(spark, d):
    """A document's first line is its title; feeds are source and language, and a feed's day has a thousand ids."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.concat_ws("/", "source", "lang").alias("feed"), F.expr("doc_id div 1000").alias("day"), F.split("text", "\n", 2)[0].alias("headline"))


@query("p20_headline_dedupe")
def _(spark, d):
    shipped(spark)
    return H.equivalent_once(_titles(spark, d), ["feed", "day"], "doc_id", "headline")


@query("p20_story_dedupe")
def _(spark, d):
    shipped(spark)
    return H.stories_once(_titles(spark, d), ["feed", "day"], "doc_id", "headline")


@query("r12_news_relevance", """
select doc_id, (contains(lower(text), 'theor') or contains(lower(text), 'thean')) and not contains(lower(text), 'worthless') and (not contains(lower(text), 'shst') or contains(left(lower(text), 80), 'the')) as relevant from documents""", views=False)
def _(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", H.relevant(F.lower("text"), F.substring(F.lower("text"), 1, 80), ["theor", "thean"], ["worthless"], ["shst"], ["the"]).alias("relevant"))
