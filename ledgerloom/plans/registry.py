"""Named queries: what runs on Spark, and the same in SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The adapter views of ``sources.tables``, as SQL; a query's SQL may start from them.
VIEWS = """
with sightings as (
  select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as tx_hash,
    o_custkey as sender, l_suppkey as receiver, cast(l_extendedprice as decimal(18,2)) as amount,
    l_shipdate as ts, l_linestatus as result, l_returnflag as kind, l_orderkey as ledger,
    l_linenumber as tx_index, l_partkey as tag, cast(l_tax as decimal(18,2)) as fee,
    cast(l_discount as decimal(18,2)) as discount, cast(l_quantity as decimal(18,2)) as quantity
  from lineitem join orders on l_orderkey = o_orderkey
), transfers as (
  select * exclude (rn) from (
    select *, row_number() over (partition by tx_hash order by ts, receiver, tag, amount, quantity, discount, fee, kind, result) as rn
    from sightings
  ) where rn = 1
), activity as (
  select event_id, ts, user_id as account, event_type as type, cast(value as decimal(18,4)) as value from events
)
"""


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a query; ``sql`` starts after the adapter views, unless ``views`` is off."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql:
            own = sql.strip()
            SQL[name] = own if not views else f"{VIEWS.strip()}{', ' + own[5:] if own.startswith('with ') else ' ' + own}"
        return f

    return add
