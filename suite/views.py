"""Inputs of the registered queries: projections of whole tables that both Spark and DuckDB understand.

The relational tables have no NULLs and no repeated rows, so the projections put some in by rule.
Every view keeps every row of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# view -> (table, expressions)
VIEWS = {
    "cust_a": ("customer", [
        "c_custkey as id", "c_name as name", "case when c_custkey % 5 = 0 then null else c_acctbal end as balance",
        "c_mktsegment as segment", "c_nationkey as nation"]),
    "ord_b": ("orders", [
        "case when o_orderkey % 11 = 0 then null else o_custkey + 100 end as id", "o_totalprice as balance",
        "o_orderpriority as segment", "o_orderstatus as status"]),
    "cust_null_key": ("customer", [
        "case when c_custkey % 7 = 0 then null else c_custkey end as id", "c_acctbal as balance"]),
    "supp_null_key": ("supplier", [
        "case when s_suppkey % 9 = 0 then null else s_suppkey * 10 end as id", "s_acctbal as balance",
        "s_nationkey as nation"]),
    "li_a": ("lineitem", ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]),
    "li_b": ("lineitem", [
        "l_linenumber", "l_quantity", "l_extendedprice",
        "case when l_linenumber < 3 then l_tax else l_discount end as l_discount", "l_returnflag"]),
    "li_c": ("lineitem", [
        "l_linenumber", "l_quantity", "l_quantity * 1000 + l_extendedprice as l_extendedprice",
        "case when l_linenumber = 2 then null else l_discount end as l_discount"]),
    "li_flat": ("lineitem", [
        "l_linenumber", "l_quantity", "l_extendedprice",
        "case when l_linenumber = 7 then null else l_discount end as l_discount", "1.5e0 as level"]),
    "li_dup": ("lineitem", [
        "l_returnflag", "l_linestatus", "case when l_linenumber = 4 then null else l_linenumber end as l_linenumber"]),
    "li_nan": ("lineitem", [
        "l_orderkey", "l_partkey", "case when l_linenumber = 3 then cast('NaN' as double) else l_quantity end as qty"]),
    "ev_null": ("events", [
        "event_id", "user_id", "case when event_id % 4 = 0 then null else value end as value",
        "case when event_id % 6 = 0 then null else event_type end as event_type"]),
    "ord_null": ("orders", [
        "o_orderkey as event_id", "case when o_orderkey % 3 = 0 then null else o_totalprice end as value",
        "o_orderstatus as status"]),
    "ord_wide": ("orders", [
        "o_orderkey as id", "o_custkey as group_id", "o_totalprice + o_custkey * 100.0e0 as mix", "o_totalprice as price",
        "o_orderkey * 2.0e0 + o_custkey as trend"]),
    "cust_wide": ("customer", [
        "c_custkey as id", "c_nationkey as group_id", "c_acctbal - c_custkey * 50.0e0 as mix", "c_acctbal as price",
        "c_custkey * 3.0e0 + c_nationkey as trend"]),
    "ord_pos": ("orders", [
        "o_orderkey as id", "o_totalprice as balance", "o_orderstatus as status"]),
    "str_num": ("lineitem", [
        "l_orderkey", "case when l_orderkey % 20 = 0 then 'n/a' else cast(cast(l_quantity as int) as varchar(10)) end as qty",
        "case when l_orderkey % 4 = 0 then 'n/a' else cast(cast(l_quantity as int) as varchar(10)) end as qty_bad"]),
    "str_date": ("orders", [
        "o_orderkey", "cast(cast(o_orderdate as date) as varchar(10)) as d",
        "case when o_orderkey % 2 = 0 then 'later-on' else cast(cast(o_orderdate as date) as varchar(10)) end as d_bad"]),
    "labels_v": ("orders", [
        "o_orderkey", "o_totalprice", "cast(cast(o_orderdate as date) as varchar(10)) as day",
        "case when o_orderkey % 9 = 0 then null else cast(cast(o_orderdate as date) as varchar(10)) end as day_gap",
        "case when o_totalprice > 100000 then 'Yes' else 'no' end as flag", "o_orderpriority as priority",
        "o_orderdate as ts"]),
    "sparse": ("customer", [
        "c_custkey", "case when c_custkey % 3 = 0 then c_acctbal end as mostly_null", "cast(null as varchar(5)) as empty",
        "'x' as constant", "c_mktsegment"]),
    "gaps": ("events", [
        "case when event_id % 4 = 0 then null else value end as value",
        "case when event_id % 8 = 0 then null else event_type end as event_type", "cast(null as double) as unnamed_1"]),
    "ev_json": ("events", [
        "event_id", "case when event_id % 6 = 0 then null when event_id % 7 = 0 then 'null' when event_id % 5 = 0 then "
        "cast(user_id as varchar(20)) when event_id % 5 = 1 then '\"' || event_type || '\"' when event_id % 5 = 2 then 'true' "
        "when event_id % 5 = 3 then '{\"k\": [1, 2]}' else event_type end as payload",
        "event_type as plain", "cast(event_id as varchar(20)) as digits"]),
    "mixed": ("part", [
        "p_partkey", "case when p_partkey % 6 = 0 then p_brand else cast(p_size as varchar(10)) end as size_text",
        "p_type", "p_retailprice"]),
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels",
          "embeddings", "pages", "benchmark", "conversations"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, exprs = VIEWS[name]
    return table(spark, sf, source).selectExpr(*exprs)


def with_views(names, body: str) -> str:
    """``body`` with the named views in front of it, for DuckDB."""
    names = [names] if isinstance(names, str) else names
    ctes = [f"{n} as (select {', '.join(VIEWS[n][1])} from {VIEWS[n][0]})" for n in names]
    body = body.strip()
    body = f", {body[4:]}" if body.startswith("with") else f" {body}"
    return f"with {', '.join(ctes)}{body}"


def union_all(parts) -> str:
    return " union all ".join(parts)
