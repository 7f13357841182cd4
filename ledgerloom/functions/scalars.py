"""Scalar functions as Column expressions. Null is never zero: parsing yields null for what is not there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DROPS = "decimal(21,0)"
#: Seconds from the Unix epoch to the ledger's; fixed value.
EPOCH = 946684800

#: Transaction type and family; fixed values.
FAMILIES = {
    "money_movement": ["Payment", "EscrowCreate", "EscrowFinish", "EscrowCancel", "CheckCreate", "CheckCash", "CheckCancel", "PaymentChannelCreate", "PaymentChannelFund", "PaymentChannelClaim"],
    "markets": ["OfferCreate", "OfferCancel", "AMMDeposit", "AMMWithdraw", "AMMBid", "AMMVote", "AMMCreate", "AMMDelete"],
    "nfts": ["NFTokenMint", "NFTokenBurn", "NFTokenCreateOffer", "NFTokenAcceptOffer", "NFTokenCancelOffer"],
    "accounts": ["TrustSet", "AccountSet", "SetRegularKey", "SignerListSet", "TicketCreate", "DepositPreauth", "Clawback", "AccountDelete"],
}
#: Currencies that count as stable; fixed values.
STABLES = ["RLUSD", "USD", "USDC", "USDT"]
#: Accounts that nobody can sign for; fixed values.
BLACKHOLES = ["rrrrrrrrrrrrrrrrrrrrrhoLvTp", "rrrrrrrrrrrrrrrrrrrrBZbvji", "rrrrrrrrrrrrrrrrrNAMEtxvNvQ"]
#: Names that mark an exchange; fixed values.
EXCHANGES = r"binance|coinbase|kraken|bitstamp|bitfinex|upbit|bithumb|bybit|okx|huobi|gate|mexc|bitso|kucoin|crypto\.com|gemini|bitrue|coinone|bitbank|coincheck"
#: Account flags; fixed values.
DISABLE_MASTER, GLOBAL_FREEZE, REQUIRE_AUTH = 0x00100000, 0x00400000, 0x00040000


def drops(text: Column) -> Column:
    """Whole drops from digits only."""
    return F.when(text.rlike(r"^[0-9]{1,21}$"), text.try_cast(DROPS))


def integer(text: Column) -> Column:
    """A whole number, truncated; null for blank, boolean and non-numbers."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double").try_cast("bigint"))


def ledger_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds + EPOCH)


def delivered(amount: Column, delivered_amount: Column) -> tuple[Column, Column, Column]:
    """The amount that counts, whether it is the delivered one, and the claimed one if that differs. JSON texts."""
    used = F.coalesce(delivered_amount != "unavailable", F.lit(False))
    return F.when(used, delivered_amount).otherwise(amount), used, F.when(used & amount.isNotNull() & (amount != delivered_amount), amount)


def parsed_amount(text: Column) -> Column:
    """struct(currency, issuer, value): drops as XRP, or an issued amount from JSON; null for anything else."""
    issued = F.from_json(text, "currency string, issuer string, value string")
    xrp = (drops(text) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(27,6)").cast("string")
    return F.when(text.rlike("^[0-9]+$"), F.struct(F.lit("XRP").alias("currency"), F.lit(None).cast("string").alias("issuer"), xrp.alias("value"))).when(
        text.startswith("{") & issued["currency"].isNotNull() & issued["issuer"].isNotNull(), F.struct(issued["currency"].alias("currency"), issued["issuer"].alias("issuer"), issued["value"].alias("value"))
    )


def asset_key(currency: Column, issuer: Column) -> Column:
    return F.concat(currency, F.lit(":"), F.coalesce(issuer, F.lit("")))


def signature(signers: Column, key: Column, sig: Column) -> Column:
    """multisig with signers, single with a key or signature, else unknown."""
    return F.when(F.coalesce(F.size(signers) > 0, F.lit(False)), "multisig").when((F.coalesce(key, F.lit("")) != "") | (F.coalesce(sig, F.lit("")) != ""), "single").otherwise("unknown")


def currency_label(code: Column) -> Column:
    """A readable currency: short alphanumeric codes in upper case, 40 hex digits decoded, else the first six characters."""
    plain = code.rlike(r"^[A-Za-z0-9]{1,12}$")
    hexed = F.when(code.rlike(r"^[0-9A-Fa-f]{40}$"), F.trim(F.replace(F.decode(F.unhex(code), "ISO-8859-1"), F.lit("\0"), F.lit(""))))
    return F.when(F.coalesce(code, F.lit("")) == "", "???").when(plain, F.upper(code)).when(hexed.rlike(r"^[A-Za-z0-9]{2,12}$"), F.upper(hexed)).otherwise(F.concat(F.substring(code, 1, 6), F.lit("…")))


def currency_hex(code: Column) -> Column:
    return F.when(code.rlike(r"^[0-9A-Fa-f]{40}$"), F.upper(code)).otherwise(F.rpad(F.substring(F.hex(code), 1, 40), 40, "0"))


def family(kind: Column) -> Column:
    out = F.lit("other")
    for name, kinds in FAMILIES.items():
        out = F.when(kind.isin(kinds), name).otherwise(out)
    return out


def flow_kind(tx: Column, source: Column, source_issuer: Column, dest: Column, dest_issuer: Column) -> Column:
    """What a transaction's flow is, from the currencies on either side."""
    crossing = ~((source == dest) & source_issuer.eqNullSafe(dest_issuer))
    return (
        F.when(tx == "TrustSet", "trustline").when(~tx.isin("Payment", "OfferCreate"), "other").when(source.isNull() | dest.isNull(), None).when(tx == "OfferCreate", "dex")
        .when(~crossing, F.when(source == "XRP", "xrp-transfer").otherwise("token-transfer")).when((source == "XRP") | (dest == "XRP"), "xrp-token")
        .when(source.isin(STABLES) | dest.isin(STABLES), "stable-route").otherwise("token-route")
    )


def out_direction(from_known: Column, to_known: Column) -> Column:
    return F.when(from_known & to_known, "INTER-EXCH").when(from_known, "EXCH-OUT").when(to_known, "EXCH-IN").otherwise("P2P")


def size_band(amount: Column) -> Column:
    return F.when(amount >= 100_000, "whale").when(amount >= 10_000, "shark").otherwise("fish")


def label_size(label: Column) -> Column:
    """The size an operator wrote into a label, as "25M" or "1.2B", kept between a million and a hundred billion."""
    number, unit = (F.regexp_extract(label, r"([0-9]+(?:\.[0-9]+)?)\s*([MB])(?![A-Za-z])", i) for i in (1, 2))
    value = number.try_cast("double") * F.when(unit == "B", 1e9).otherwise(1e6)
    return F.when(value.between(1e6, 1e11), value)


def digest(*columns: str) -> Column:
    """sha256 of the canonical JSON of the columns, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def report_day(name: Column) -> Column:
    """The date in SW-YYYYMMDD-XXXXX, null unless it is on the calendar."""
    day = F.regexp_extract(name, r"^SW-([0-9]{8})-[A-Z0-9]{5}$", 1)
    return F.try_to_date(F.nullif(day, F.lit("")), "yyyyMMdd")


def wallet_score(found: Column, age_years: Column, balance: Column, exchange_funded: Column, created: Column, cancelled: Column) -> Column:
    """0 to 8 from age, balance, who funded it and how often its offers are cancelled: struct(score, rating)."""
    n = lambda c: F.coalesce(c, F.lit(0))
    offers = n(created) + n(cancelled)
    ratio = n(cancelled) / F.greatest(offers, F.lit(1))
    steps = lambda c, high, low: F.when(c > high, 2).when(c > low, 1).otherwise(0)
    score = steps(n(age_years), 2, 0.5) + steps(n(balance), 100_000, 10_000) + F.when(F.coalesce(exchange_funded, F.lit(False)), 2).otherwise(0) + F.when((offers == 0) | ((ratio >= 0.4) & (ratio < 0.7)), 1).when(ratio < 0.4, 2).otherwise(0)
    score = F.when(F.coalesce(found, F.lit(False)), score).otherwise(0)
    return F.struct(score.alias("score"), F.when(score >= 6, "green").when(score >= 3, "yellow").otherwise("red").alias("rating"))


def token_health(holders: Column, trustlines: Column, liquidity: Column) -> Column:
    h, t, q = (F.coalesce(c, F.lit(0)) for c in (holders, trustlines, liquidity))
    return F.when((h >= 5000) | (q >= 250_000), "healthy").when((h >= 500) | (t >= 500) | (q >= 20_000), "moderate").when((h > 0) | (t > 0), "thin").otherwise("unknown")


def blackholed(flags: Column, regular_key: Column, burned: list[str] = BLACKHOLES) -> Column:
    """The master key is off and no regular key can sign."""
    return (flags.bitwiseAND(DISABLE_MASTER) != 0) & (regular_key.isNull() | regular_key.isin(burned))


def account_risk(found: Column, issuer: Column, black: Column, flags: Column, age_days: Column, balance: Column, lines: Column, lines_capped: Column, transactions: Column) -> Column:
    """0 to 100 by adding up what speaks against an account: struct(score, band)."""
    add = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = (
        add(issuer & ~black, 30) + add(flags.bitwiseAND(GLOBAL_FREEZE) != 0, 25) + add(flags.bitwiseAND(REQUIRE_AUTH) != 0, 8)
        + F.when(age_days.isNull(), 5).when(age_days < 7, 28).when(age_days < 30, 15).otherwise(0)
        + F.when(balance < 1, 20).when(balance < 15, 6).otherwise(0) + add(issuer & ~lines_capped & (lines <= 5), 12) + add(transactions == 0, 8)
    )
    score = F.when(F.coalesce(found, F.lit(False)), F.greatest(F.lit(0), F.least(F.lit(100), score))).otherwise(80)
    return F.struct(score.alias("score"), F.when(score >= 65, "CRITICAL RISK").when(score >= 40, "HIGH RISK").when(score >= 20, "ELEVATED").otherwise("LOW RISK").alias("band"))


def market_band(price: Column, change: Column) -> Column:
    inside = price.between(1.28, 1.55)
    return F.concat(F.when(inside, "IN_BAND").otherwise("OUT_OF_BAND"), F.when(change > 1, "_UP").when(change < -1, "_DOWN").otherwise("_FLAT"))


def name_type(name: Column) -> Column:
    """RIPPLE, EXCH or HVT from a display name."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(F.contains(n, F.lit("ripple")), "RIPPLE").when(n.rlike(EXCHANGES), "EXCH").otherwise("HVT")


def compact(value: Column, decimals: int = 1) -> Column:
    """1234567 as 1.2M; the number of decimals is the caller's."""
    f = lambda c: F.format_string(f"%.{decimals}f", c)
    v = value.cast("double")
    return F.when(F.abs(v) >= 1e9, F.concat(f(v / 1e9), F.lit("B"))).when(F.abs(v) >= 1e6, F.concat(f(v / 1e6), F.lit("M"))).when(F.abs(v) >= 1e3, F.concat(f(v / 1e3), F.lit("K"))).otherwise(f(v))


def watch_level(score: Column, checked: Column, total: Column) -> Column:
    """The verdict on a score; none while the board is not read in full."""
    share = checked / F.greatest(total, F.lit(1))
    return F.when(share < 0.6, "WITHHELD_SEVERE").when(share < 1, "WITHHELD_DEGRADED").when(score >= 75, "high").when(score >= 50, "elevated").when(score >= 25, "moderate").otherwise("low")


def direct_payment(currency: Column, sender: Column, receiver: Column, cross_currency: Column) -> Column:
    """A payment in the native asset from one account to another that did not ask for another currency; null in the first three is no payment, null in the last is no."""
    return F.coalesce((currency == "XRP") & (sender != receiver), F.lit(False)) & ~F.coalesce(cross_currency, F.lit(False))
