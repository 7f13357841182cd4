"""Metadata facts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exact as X
from ..functions import scalars as S
from ..operators import events as E
from ..operators import ledgerdata as L
from ..shipping import shipped
from ..sources.ledger_json import ASSET, payloads, payments
from ..sources.tables import sightings, table, transfers
from .registry import query

#: What the facts must be, from the transfers they were written from.
_OK = "l as (select *, upper(sha256(tx_hash)) as hash from transfers), ok as (select * from l where result = 'F' and tag % 40 <> 0 and tag % 50 <> 0)"


def _facts(spark, d):
    shipped(spark)
    return L.inspected(payloads(spark, d), [f"{ASSET[0]}:{ASSET[1]}"])


@query("l1_balances", f"""
with {_OK}, b as (
  select hash, 'rC' || sender as account, 'XRP:' as asset, cast(-amount as double) as delta from ok union all select hash, 'rC' || sender, 'USD:rIssuer', cast(quantity as double) from ok
  union all select hash, 'rS' || receiver, 'XRP:', cast(amount as double) from ok union all select hash, 'rS' || receiver, 'USD:rIssuer', cast(-quantity as double) from ok)
select account, asset, count(*) as n, round(sum(delta), 2) as delta from b group by 1, 2""")
def _(spark, d):
    b = _facts(spark, d).select(F.explode("balances").alias("b")).select("b.*").where("account like 'r%' and account <> 'rIssuer'")
    g = b.groupBy("account", "asset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("delta").cast("decimal(28,8)")).alias("delta"))
    return g.withColumn("delta", F.round(F.col("delta").cast("double"), 2))


@query("l2_inspect_status", """
select case when result <> 'F' then 'NOT_SUCCESSFUL_VALIDATED' when tag % 40 = 0 then 'MISSING_RAW_METADATA' when tag % 50 = 0 then 'PAYLOAD_EVENT_MISMATCH' else 'ANALYZED' end as status, count(*) as n from transfers group by 1""")
def _(spark, d):
    return _facts(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("l3_exchange_legs", f"""
with {_OK}, e as (
  select 'rC' || sender as account, 'OFFERCREATE_OWNER' as basis, 'SELL_XRP' as side, amount, quantity from ok
  union all select 'rS' || receiver, 'CONSUMED_OFFER_OWNER', 'BUY_XRP', amount, quantity from ok where kind <> 'N')
select account, basis, side, cast(amount as double) as xrp, cast(quantity as double) as stable,
  (cast(quantity * 100 as bigint) // gcd(cast(quantity * 100 as bigint), cast(amount * 100 as bigint))) || '/' || (cast(amount * 100 as bigint) // gcd(cast(quantity * 100 as bigint), cast(amount * 100 as bigint))) as price from e""")
def _(spark, d):
    e = _facts(spark, d).select(F.explode("exchanges").alias("e")).select("e.*")
    return e.select("account", "basis", "side", F.col("xrp").cast("double").alias("xrp"), F.col("stable").cast("double").alias("stable"), "price")


@query("l4_order_book_fills", f"""
with {_OK} select 'rS' || receiver as account, case kind when 'R' then 'PARTIAL' else 'FULL' end as completion, count(*) as n, cast(sum(amount) as double) as xrp, cast(sum(quantity) as double) as stable from ok where kind <> 'N' group by 1, 2""")
def _(spark, d):
    f = _facts(spark, d).select(F.explode("fills").alias("f")).select("f.*").where("venue = 'ORDER_BOOK'")
    dec = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double").alias(c)
    return f.groupBy("account", "completion").agg(F.count(F.lit(1)).alias("n"), dec("xrp"), dec("stable"))


@query("l5_pool_swaps", f"""
with {_OK} select 'rS' || receiver as account, 'BUY_XRP' as side, count(*) as n, cast(sum(amount) as double) as xrp, cast(sum(quantity) as double) as stable from ok where kind = 'N' group by 1""")
def _(spark, d):
    f = _facts(spark, d).select(F.explode("fills").alias("f")).select("f.*").where("venue = 'AMM'")
    dec = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double").alias(c)
    return f.groupBy("account", "side").agg(F.count(F.lit(1)).alias("n"), dec("xrp"), dec("stable"))


@query("l6_execution_status", """
select case when result <> 'F' then 'NOT_SUCCESSFUL_VALIDATED' when tag % 40 = 0 then 'UNSUPPORTED' when tag % 50 = 0 then 'NO_MATCH' else 'VERIFIED_EXECUTIONS' end as status, count(*) as n from transfers group by 1""")
def _(spark, d):
    return _facts(spark, d).groupBy(F.col("execution").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("l7_order_sides", f"""
with {_OK} select 'rC' || sender as account, 'SELL_XRP' as side, count(*) as n from ok group by 1""")
def _(spark, d):
    o = _facts(spark, d).select(F.explode("orders").alias("o")).select("o.*")
    return o.where("side is not null").groupBy("account", "side").agg(F.count(F.lit(1)).alias("n"))


_EVENTS = """e as (
  select tx_hash, tag, kind, receiver, tag % 40 <> 0 as there, kind = 'N' and tag % 2 = 0 as finish, upper(sha256(tx_hash)) as hash, ledger, tx_index, result, 'rC' || sender as c, 'rS' || receiver as s, quantity,
    cast(cast(amount * 100 as bigint) * 10000 as varchar) as claimed, cast(cast(quantity * 100 as bigint) * 10000 as varchar) as got from {rows})"""


@query("f1_event_rows", f"""
with {_EVENTS.format(rows="transfers")}
select tx_hash, case when there then hash end as hash, ledger as ledger_index, case when there then (ledger * 10 + 946684800) * 1000 end as close_time_ms, case when there then strftime(make_timestamp((ledger * 10 + 946684800) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') end as close_time_iso,
  case when not there then null when finish then 'EscrowFinish' when kind = 'N' then 'EscrowCreate' else 'Payment' end as tx_type, case result when 'F' then 'tesSUCCESS' else 'tecPATH_DRY' end as tx_result, true as validated,
  case when there then c end as from_account, case when there then s end as to_account,
  case when kind = 'A' and tag % 3 = 2 then cast(got as bigint) when kind = 'A' and there then cast(claimed as bigint) end as amount_drops, case when kind = 'R' and there then cast(quantity as double) end as amount_value,
  case when kind = 'R' and there then 'USD' else 'XRP' end as currency, case when kind = 'R' and there then 'rI' || receiver end as issuer, case when there and tag % 2 = 0 then tag % 3 end as destination_tag,
  case when there and tag % 3 <> 0 then 7 end as source_tag, case when not there or tag % 7 >= 4 then 'unknown' when tag % 7 = 0 then 'multisig' else 'single' end as sig_mode, case when not there or tag % 7 >= 4 then 0 when tag % 7 = 0 then 2 else 1 end as signer_count,
  case when finish then 'rO' || receiver when kind = 'N' and there then c end as escrow_owner, case when finish then s end as escrow_destination, case when finish then cast(claimed as bigint) end as escrow_amount_drops,
  case when there and tag % 7 <> 6 then 12 end as fee_drops, case when there then ledger end as sequence, cast(null as bigint) as tx_flags, tx_index as transaction_index, 'r1' as roster_version, s as observed_via, 'scan' as scan_id,
  case when kind = 'A' and tag % 3 = 2 and there and got <> claimed then claimed end as overridden, kind = 'A' and tag % 3 = 2 as delivered_used, case when finish then 2 else 0 end as escrow_nodes, 1 as balance_deltas
from e""")
def _(spark, d):
    p = payments(transfers(spark, d)).withColumns({"run": F.lit("scan"), "at_roster": F.lit("r1")})
    e = E.event_rows(p, ledger="entry_ledger", observed_via="observed_via", scan_id="run", roster="at_roster")
    x = F.col("evidence")
    facts = e.withColumns({
        **{c: F.col(c).cast("long") for c in ("amount_drops", "escrow_amount_drops", "fee_drops")}, "amount_value": F.col("amount_value").cast("double"),
        "overridden": x["raw_amount_overridden"], "delivered_used": x["delivered_amount_used"], "escrow_nodes": x["escrow_nodes_seen"], "balance_deltas": F.size(x["balance_deltas"]),
    })
    return facts.drop("raw_tx", "raw_meta", "evidence", "run", "at_roster", "entry_ledger")


_CLAIM = "cast(cast(amount * 100 as bigint) as varchar)"


@query("f2_delivered_amount", f"""
select tx_hash, case when tag % 3 = 1 then {_CLAIM} when tag % 3 = 2 then '1' || {_CLAIM} else {_CLAIM} end as amount, tag % 3 = 2 as used, case when tag % 3 = 2 then {_CLAIM} end as overridden from transfers""")
def _(spark, d):
    claim = (F.col("amount") * 100).cast("bigint").cast("string")
    got = F.when(F.col("tag") % 3 == 1, "unavailable").when(F.col("tag") % 3 == 2, F.concat(F.lit("1"), claim))
    amount, used, over = S.delivered(claim, got)
    return transfers(spark, d).select("tx_hash", amount.alias("amount"), used.alias("used"), over.alias("overridden"))


@query("f3_drops_parse", f"""
select tx_hash, case when tag % 4 = 0 then null when tag % 4 = 1 then null else cast({_CLAIM} as double) end as drops from transfers""")
def _(spark, d):
    claim = (F.col("amount") * 100).cast("bigint").cast("string")
    text = F.when(F.col("tag") % 4 == 0, F.concat(F.lit("-"), claim)).when(F.col("tag") % 4 == 1, F.concat(claim, F.lit(".5"))).otherwise(claim)
    return transfers(spark, d).select("tx_hash", S.drops(text).cast("double").alias("drops"))


@query("f4_null_preserving_int", """
select tx_hash, case tag % 5 when 0 then null when 1 then null when 2 then cast(trunc(amount) as bigint) when 3 then 0 else tag end as n from transfers""")
def _(spark, d):
    text = F.when(F.col("tag") % 5 == 0, "").when(F.col("tag") % 5 == 1, "true").when(F.col("tag") % 5 == 2, F.col("amount").cast("string")).when(F.col("tag") % 5 == 3, "0").otherwise(F.col("tag").cast("string"))
    return transfers(spark, d).select("tx_hash", S.integer(text).alias("n"))


@query("f5_ledger_epoch", "select tx_hash, ledger * 1000 + 946684800 as close from transfers")
def _(spark, d):
    return transfers(spark, d).select("tx_hash", F.unix_timestamp(S.ledger_time(F.col("ledger") * 1000)).alias("close"))


@query("f6_escrow_facts", """
select tx_hash, case when kind = 'N' then 'rC' || sender when tag % 2 = 0 then 'rO' || receiver end as owner, case when kind = 'N' then 0 when tag % 2 = 0 then 2 else 0 end as nodes_seen from transfers""")
def _(spark, d):
    t = transfers(spark, d)
    node = F.struct(F.lit("Escrow").alias("type"), F.concat(F.lit("rO"), F.col("receiver").cast("string")).alias("owner"))
    other = F.struct(F.lit("Offer").alias("type"), F.lit("x").alias("owner"))
    nodes = F.when((F.col("kind") != "N") & (F.col("tag") % 2 == 0), F.array(other, node, node)).otherwise(F.array(other))
    found = F.filter(nodes, lambda n: n["type"] == "Escrow")
    # a create is its submitter's own; a finish or cancel without a readable node stays unknown
    owner = F.coalesce(F.get(found, F.lit(0))["owner"], F.when(F.col("kind") == "N", F.concat(F.lit("rC"), F.col("sender").cast("string"))))
    return t.select("tx_hash", owner.alias("owner"), F.size(found).alias("nodes_seen"))


@query("f7_signature_facts", "select tx_hash, case when tag % 7 = 0 then 'multisig' when tag % 7 < 4 then 'single' else 'unknown' end as mode from transfers")
def _(spark, d):
    signers = F.when(F.col("tag") % 7 == 0, F.array(F.lit("a"), F.lit("b")))
    return transfers(spark, d).select("tx_hash", S.signature(signers, F.when(F.col("tag") % 7 < 4, "key"), F.lit(None).cast("string")).alias("mode"))


@query("f8_root_deltas", f"""
with {_OK} select 'rC' || sender as account, count(*) as n, cast(-sum(amount) as double) - round(count(*) * 0.000012, 6) as delta from ok group by 1""")
def _(spark, d):
    fields = "Account string, Balance string"
    node = f"array<struct<ModifiedNode:struct<LedgerEntryType:string,FinalFields:struct<{fields.replace(' ', ':').replace(',:', ',')}>,PreviousFields:struct<Balance:string>>>>"
    p = payloads(spark, d).where("raw_tx is not null and tx_result = 'tesSUCCESS'").join(transfers(spark, d).where("tag % 50 <> 0").select("tx_hash"), "tx_hash", "left_semi")
    n = p.select(F.explode(F.from_json("raw_meta", f"AffectedNodes {node}")["AffectedNodes"]["ModifiedNode"]).alias("n")).where("n.LedgerEntryType = 'AccountRoot' and n.FinalFields.Account like 'rC%'")
    drops = F.col("n.FinalFields.Balance").cast("decimal(24,0)") - F.col("n.PreviousFields.Balance").cast("decimal(24,0)")
    g = n.groupBy(F.col("n.FinalFields.Account").alias("account")).agg(F.count(F.lit(1)).alias("n"), F.sum(drops).alias("dr"))
    whole = ((F.col("dr") + F.col("n") * 12) / 1_000_000).cast("decimal(24,2)").cast("double")
    return g.select("account", "n", (whole - F.round(F.col("n") * F.lit(0.000012), 6)).alias("delta"))


@query("f9_participants", f"""
with {_EVENTS.format(rows="sightings")}
select distinct hash, address, role from (
  select hash, c as address, 'submitter' as role from e where there union all select hash, s, 'destination' from e where there union all select hash, s, 'observed_via' from e where there
  union all select hash, case when finish then 'rO' || receiver else c end, 'escrow_owner' from e where kind = 'N' and there union all select hash, s, 'escrow_destination' from e where finish and there
  union all select hash, 'rI' || receiver, 'issuer' from e where kind = 'R' and there
  union all select hash, unnest(['rA' || (tag % 5), 'rB' || (tag % 5)]), 'signer' from e where tag % 7 = 0 and there)""")
def _(spark, d):
    return E.participants(E.event_rows(payments(sightings(spark, d)), observed_via="observed_via"))


@query("f10_exact_sum", "select tx_hash, cast(amount + quantity as double) as total from transfers")
def _(spark, d):
    shipped(spark)
    t = transfers(spark, d).select("tx_hash", X.exact_sum(F.col("amount").cast("string"), F.col("quantity").cast("string")).alias("s"))
    return t.select("tx_hash", F.col("s").cast("double").alias("total"))


@query("f11_sum_drops", """
select sender, cast(sum(case when tag % 4 > 1 then cast(amount * 100 as bigint) end) as double) as drops, count(*) as n from transfers group by 1""")
def _(spark, d):
    claim = (F.col("amount") * 100).cast("bigint").cast("string")
    text = F.when(F.col("tag") % 4 > 1, claim).otherwise("x")
    return transfers(spark, d).groupBy("sender").agg(F.sum(S.drops(text)).cast("double").alias("drops"), F.count(F.lit(1)).alias("n"))


@query("f12_price_fraction", """
select tx_hash, (cast(quantity * 100 as bigint) // gcd(cast(quantity * 100 as bigint), cast(amount * 100 as bigint))) || '/' || (cast(amount * 100 as bigint) // gcd(cast(quantity * 100 as bigint), cast(amount * 100 as bigint))) as price from transfers""")
def _(spark, d):
    shipped(spark)
    return transfers(spark, d).select("tx_hash", X.price_fraction(F.col("quantity").cast("string"), F.col("amount").cast("string")).alias("price"))


@query("f13_amount_parse", """
select tx_hash, case when kind = 'N' then 'USD:rI' || receiver else 'XRP:' end as asset, case when kind = 'N' then cast(quantity as double) else cast(amount as double) end as value from transfers""")
def _(spark, d):
    issued = F.to_json(F.struct(F.lit("USD").alias("currency"), F.concat(F.lit("rI"), F.col("receiver").cast("string")).alias("issuer"), F.col("quantity").cast("string").alias("value")))
    a = S.parsed_amount(F.when(F.col("kind") == "N", issued).otherwise((F.col("amount") * 1_000_000).cast("decimal(24,0)").cast("string")))
    return transfers(spark, d).select("tx_hash", a.alias("a")).select("tx_hash", S.asset_key(F.col("a.currency"), F.col("a.issuer")).alias("asset"), F.col("a.value").cast("double").alias("value"))


@query("f14_currency_label", """
select p_partkey, case p_partkey % 4 when 0 then '???' when 1 then 'C' || p_partkey when 2 then 'TOKEN' || (p_partkey % 100) else left('x-' || p_partkey || '-long', 6) || '…' end as label from part""", views=False)
def _(spark, d):
    k = F.col("p_partkey")
    hexed = F.rpad(F.hex(F.concat(F.lit("token"), (k % 100).cast("string"))), 40, "0")
    code = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("c"), k.cast("string"))).when(k % 4 == 2, hexed).otherwise(F.concat(F.lit("x-"), k.cast("string"), F.lit("-long")))
    return table(spark, d, "part").select("p_partkey", S.currency_label(code).alias("label"))


@query("f15_currency_hex", "select p_partkey, rpad(hex('T' || p_partkey), 40, '0') as code from part", views=False)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.currency_hex(F.concat(F.lit("T"), F.col("p_partkey").cast("string"))).alias("code"))


@query("f16_transaction_family", """
select event_id, case event_type when 'purchase' then 'money_movement' when 'click' then 'markets' when 'view' then 'nfts' when 'signup' then 'accounts' else 'other' end as family from events""", views=False)
def _(spark, d):
    t = F.col("event_type")
    kind = F.when(t == "purchase", "Payment").when(t == "click", "AMMDeposit").when(t == "view", "NFTokenMint").when(t == "signup", "TrustSet").otherwise("Unheard")
    return table(spark, d, "events").select("event_id", S.family(kind).alias("family"))


@query("f17_flow_kind", """
with x as (select tx_hash, ['TrustSet', 'Payment', 'OfferCreate', 'Other'][1 + tag % 4] as tx, ['XRP', 'USD', 'ABC', 'XYZ'][1 + sender % 4] as s, ['XRP', 'USD', 'ABC', 'XYZ'][1 + receiver % 4] as d, sender % 2 as si, receiver % 3 as di from transfers)
select tx_hash, case when tx = 'TrustSet' then 'trustline' when tx = 'Other' then 'other' when tx = 'OfferCreate' then 'dex' when s = d and si = di then case when s = 'XRP' then 'xrp-transfer' else 'token-transfer' end
  when s = 'XRP' or d = 'XRP' then 'xrp-token' when s = 'USD' or d = 'USD' then 'stable-route' else 'token-route' end as kind from x""")
def _(spark, d):
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % 4 + 1).cast("int"))
    codes = ["XRP", "USD", "ABC", "XYZ"]
    k = S.flow_kind(pick(["TrustSet", "Payment", "OfferCreate", "Other"], F.col("tag")), pick(codes, F.col("sender")), F.col("sender") % 2, pick(codes, F.col("receiver")), F.col("receiver") % 3)
    return transfers(spark, d).select("tx_hash", k.alias("kind"))


@query("f18_out_direction", """
select tx_hash, case when sender % 3 = 0 and receiver % 4 = 0 then 'INTER-EXCH' when sender % 3 = 0 then 'EXCH-OUT' when receiver % 4 = 0 then 'EXCH-IN' else 'P2P' end as direction from transfers""")
def _(spark, d):
    return transfers(spark, d).select("tx_hash", S.out_direction(F.col("sender") % 3 == 0, F.col("receiver") % 4 == 0).alias("direction"))


@query("f19_size_band", "select case when amount >= 100000 then 'whale' when amount >= 10000 then 'shark' else 'fish' end as band, count(*) as n, cast(sum(amount) as double) as total from transfers group by 1")
def _(spark, d):
    return transfers(spark, d).groupBy(S.size_band(F.col("amount")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))


@query("f20_compact_numbers", """
with c as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents from orders),
t as (select o_orderkey, cents >= 100000 as k, case when cents >= 100000 then (cents + 5000) // 10000 else (cents + 5) // 10 end as tenths from c)
select o_orderkey, (tenths // 10) || '.' || (tenths % 10) || case when k then 'K' else '' end as short from t""", views=False)
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.compact(F.col("o_totalprice")).alias("short"))


@query("f21_valid_address")
def _(spark, d):
    shipped(spark)
    c = table(spark, d, "customer").select("c_custkey")
    known = F.when(F.col("c_custkey") % 2 == 0, "rrrrrrrrrrrrrrrrrrrrrhoLvTp").when(F.col("c_custkey") % 3 == 0, "rrrrrrrrrrrrrrrrrrrrBZbvji").otherwise(F.concat(F.lit("rrrrrrrrrrrrrrrrrrrrr"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", X.is_address(known).alias("valid"))


@query("f22_label_size", """
select c_custkey, case when c_custkey % 4 = 0 then c_custkey * 1e6 when c_custkey % 4 = 1 and c_custkey <= 1000 then c_custkey * 1e8 end as size from customer where c_custkey > 0""", views=False)
def _(spark, d):
    k = F.col("c_custkey")
    label = F.when(k % 4 == 0, F.concat(F.lit("Whale "), k.cast("string"), F.lit("M"))).when(k % 4 == 1, F.concat(F.lit("Box "), (k / 10).cast("string"), F.lit(" B old"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit("Mx"))).otherwise("none")
    return table(spark, d, "customer").where("c_custkey > 0").select("c_custkey", F.round(S.label_size(label), 0).alias("size"))


@query("f23_canonical_digest", """select n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') as digest from nation""", views=False)
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.digest("n_nationkey", "n_name").alias("digest"))


@query("f24_roster_identity", "select sha256(string_agg(distinct cast(c_custkey as varchar), chr(10) order by cast(c_custkey as varchar))) as id, count(*) as n from customer where c_custkey % 7 = 0", views=False)
def _(spark, d):
    r = table(spark, d, "customer").where("c_custkey % 7 = 0")
    ids = F.array_join(F.array_sort(F.collect_set(F.col("c_custkey").cast("string"))), "\n")  # one row of a roster
    return r.agg(F.sha2(ids.cast("binary"), 256).alias("id"), F.count(F.lit(1)).alias("n"))


@query("f25_report_day", """
select o_orderkey, case when o_orderkey % 3 > 0 then cast(o_orderdate as date) end as day from orders""", views=False)
def _(spark, d):
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("SW-"), day, F.lit("-AB12C"))).otherwise("SW-20239999-AB12C")
    return o.select("o_orderkey", S.report_day(name).alias("day"))


@query("f26_wallet_score", """
with x as (select c_custkey as k, c_custkey % 50 > 0 as found, (c_custkey % 40) / 10 as age, c_acctbal * 20 as bal, c_custkey % 3 = 0 as ex, c_custkey % 6 as cr, c_custkey % 11 as ca from customer),
s as (select k, case when not found then 0 else case when age > 2 then 2 when age > 0.5 then 1 else 0 end + case when bal > 100000 then 2 when bal > 10000 then 1 else 0 end + case when ex then 2 else 0 end
  + case when cr + ca = 0 then 1 when ca * 1.0 / (cr + ca) < 0.4 then 2 when ca * 1.0 / (cr + ca) < 0.7 then 1 else 0 end end as score from x)
select k, score, case when score >= 6 then 'green' when score >= 3 then 'yellow' else 'red' end as rating from s""", views=False)
def _(spark, d):
    k = F.col("c_custkey")
    s = S.wallet_score(k % 50 > 0, (k % 40) / 10, F.col("c_acctbal") * 20, k % 3 == 0, k % 6, k % 11)
    return table(spark, d, "customer").select(k.alias("k"), s.alias("s")).select("k", "s.score", "s.rating")


@query("f27_token_health", """
select p_partkey, case when p_size * 120 >= 5000 or p_retailprice * 200 >= 250000 then 'healthy' when p_size * 120 >= 500 or p_partkey % 700 >= 500 or p_retailprice * 200 >= 20000 then 'moderate' else 'thin' end as tier from part""", views=False)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.token_health(F.col("p_size") * 120, F.col("p_partkey") % 700, F.col("p_retailprice") * 200).alias("tier"))


@query("f28_account_risk", """
with x as (select c_custkey as k, c_custkey % 60 > 0 as found, c_custkey % 4 = 0 as iss, c_custkey % 8 = 0 as black, c_custkey % 5 = 0 as frz, c_custkey % 7 = 0 as auth, case when c_custkey % 9 > 0 then c_custkey % 90 end as age,
  c_acctbal / 100 as bal, c_custkey % 12 as lines, c_custkey % 6 = 0 as capped, c_custkey % 10 as tx from customer),
s as (select k, case when not found then 80 else least(100, case when iss and not black then 30 else 0 end + case when frz then 25 else 0 end + case when auth then 8 else 0 end
  + case when age is null then 5 when age < 7 then 28 when age < 30 then 15 else 0 end + case when bal < 1 then 20 when bal < 15 then 6 else 0 end + case when iss and not capped and lines <= 5 then 12 else 0 end + case when tx = 0 then 8 else 0 end) end as score from x)
select k, score, case when score >= 65 then 'CRITICAL RISK' when score >= 40 then 'HIGH RISK' when score >= 20 then 'ELEVATED' else 'LOW RISK' end as band from s""", views=False)
def _(spark, d):
    k = F.col("c_custkey")
    flags = F.when(k % 5 == 0, S.GLOBAL_FREEZE).otherwise(0).bitwiseOR(F.when(k % 7 == 0, S.REQUIRE_AUTH).otherwise(0))
    s = S.account_risk(k % 60 > 0, k % 4 == 0, k % 8 == 0, flags, F.when(k % 9 > 0, k % 90), F.col("c_acctbal") / 100, k % 12, k % 6 == 0, k % 10)
    return table(spark, d, "customer").select(k.alias("k"), s.alias("s")).select("k", "s.score", "s.band")


@query("f29_blackholed", "select c_custkey as k, c_custkey % 2 = 0 and (c_custkey % 3 = 0 or c_custkey % 5 = 0) as black from customer", views=False)
def _(spark, d):
    k = F.col("c_custkey")
    key = F.when(k % 3 == 0, None).when(k % 5 == 0, S.BLACKHOLES[0]).otherwise("rOwn")
    return table(spark, d, "customer").select(k.alias("k"), S.blackholed(F.when(k % 2 == 0, S.DISABLE_MASTER | 1).otherwise(1), key).alias("black"))


@query("f30_display_name", """
select c_custkey as k, coalesce(case when c_custkey % 5 = 0 then 'op-' || c_custkey end, s_name, case when c_custkey % 3 = 0 then 'a ' || lower(c_mktsegment) || ' account' end, 'unknown account') as name from customer left join supplier on s_suppkey = c_custkey""", views=False)
def _(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.expr("s_suppkey = c_custkey"), "left")
    k = F.col("c_custkey")
    return c.select(k.alias("k"), F.coalesce(F.when(k % 5 == 0, F.concat(F.lit("op-"), k.cast("string"))), "s_name", F.when(k % 3 == 0, F.concat(F.lit("a "), F.lower("c_mktsegment"), F.lit(" account"))), F.lit("unknown account")).alias("name"))


@query("f31_market_band", """
select event_id, case when value / 100 between 1.28 and 1.55 then 'IN_BAND' else 'OUT_OF_BAND' end || case when event_id % 5 - 2 > 1 then '_UP' when event_id % 5 - 2 < -1 then '_DOWN' else '_FLAT' end as band from events""", views=False)
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.market_band(F.col("value") / 100, F.col("event_id") % 5 - 2).alias("band"))
