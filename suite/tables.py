"""Sources, sinks, schema operators, cleaning, type conversion, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendscope import catalog, clean, fuse, io, ml, profile, schema, types
from blendscope.session import scratch_path

from .stats import NUMBER, rounded
from .views import table, union_all, view, with_views

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


# ---------------------------------------------------------------- sources

@register("s1_read_csv", """select o_orderkey, case when o_orderkey % 7 > 0 and o_orderkey % 11 > 0 then o_orderstatus
    end as status, o_totalprice, case when o_orderkey % 5 > 0 then o_custkey end as cust from orders""")
def s1(spark, sf):
    path = scratch_path(spark, "csv")
    io.export(table(spark, sf, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 7 = 0 then 'N/A' when o_orderkey % 11 = 0 then 'NULL' else o_orderstatus "
        "end as status", "o_totalprice",
        "case when o_orderkey % 5 = 0 then 'n/a' else cast(o_custkey as string) end as cust"), path, "csv")
    return io.read_csv(spark, path)


@register("s2_preview", with_views("ev_null", """select cast(event_id as varchar) as event_id,
    cast(user_id as varchar) as user_id, coalesce(cast(value as varchar), '') as value,
    coalesce(event_type, '') as event_type from ev_null order by ev_null.event_id limit 5"""))
def s2(spark, sf):
    return io.preview(view(spark, sf, "ev_null"), 5, ["event_id"])


@register("s3_nan_to_null", """select l_orderkey, l_partkey, case when l_linenumber = 3 then null else l_quantity end
    as qty from lineitem""")
def s3(spark, sf):
    return io.nan_to_null(view(spark, sf, "li_nan"))


@register("s4_source_size")
def s4(spark, sf):
    return io.source_size(table(spark, sf, "lineitem"))


@register("s5_list_sources")
def s5(spark, sf):
    return catalog.list_sources(spark.read.parquet(f"{sf}/orders.parquet", f"{sf}/customer.parquet").select("_metadata"))


@register("s6_load_stored", with_views("ord_b", union_all([
    f"select '{c}' as \"column\", count(*) - count({c}) as null_count from ord_b"
    for c in ("id", "balance", "segment", "status")])))
def s6(spark, sf):
    path = scratch_path(spark, "stored")
    catalog.save_stats(profile.null_counts(view(spark, sf, "ord_b")).select("column", "null_count"), path)
    return catalog.load(spark, path)


@register("s7_catalog_cards", """with s as (select distinct source || '/' || lang as dataset from documents
      union all select 'pages/' || regexp_extract(url, '^[a-z]+', 0) from pages group by 1),
    p as (select source || '/' || lang as dataset, sum(n_chars) || ' chars' as size,
      cast(round(100.0e0 * avg(quality), 2) as varchar) as quality_score
      from documents join labels using (doc_id) group by 1)
    select dataset, coalesce(size, 'N/A') as size, coalesce(quality_score, 'N/A') as quality_score
    from s left join p using (dataset)""")
def s7(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("/", "source", "lang").alias("dataset"), "n_chars")
    pages = table(spark, sf, "pages").select(F.concat(F.lit("pages/"), F.regexp_extract("url", "^[a-z]+", 0)).alias("dataset"))
    stored = docs.join(table(spark, sf, "labels"), "doc_id").groupBy("dataset").agg(
        F.concat(F.sum("n_chars").cast("string"), F.lit(" chars")).alias("size_text"),
        (F.avg("quality") * 100.0).alias("quality_score"))
    return catalog.cards(docs.select("dataset").distinct().unionByName(pages.distinct()), stored)


# ---------------------------------------------------------------- sinks

@register("k1_export_csv", with_views("ord_b", "select * from ord_b"))
def k1(spark, sf):
    df = view(spark, sf, "ord_b")
    path = io.export(df, scratch_path(spark, "out-csv"), "csv")
    return spark.read.csv(path, header=True, schema=df.schema)


@register("k2_export_json", with_views("ord_b", "select * from ord_b"))
def k2(spark, sf):
    df = view(spark, sf, "ord_b")
    path = io.export(df, scratch_path(spark, "out-json"), "json")
    return spark.read.json(path, schema=df.schema).select(*df.columns)


@register("k2_export_json_millis", "select o_orderkey, epoch_ms(o_orderdate) as o_orderdate from orders")
def k2_millis(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    path = io.export(df, scratch_path(spark, "out-json"), "json", unix_millis=True)
    return spark.read.json(path, schema="o_orderkey bigint, o_orderdate bigint")


@register("k3_save_stats", with_views(["li_a", "li_b"], """select 'union' as strategy, cast(null as varchar) as primary_key,
    (select count(*) from li_a) as rows_before_a, (select count(*) from li_b) as rows_before_b, 5 as cols_before_a,
    5 as cols_before_b, count(*) as rows_after, 5 as cols_after, cast(0 as bigint) as missing_cells,
    0.0e0 as missing_ratio, cast(0 as bigint) as duplicate_rows from (select * from li_a union select * from li_b)"""))
def k3(spark, sf):
    a, b = view(spark, sf, "li_a"), view(spark, sf, "li_b")
    path = scratch_path(spark, "stats")
    catalog.save_stats(fuse.stats(a, b, fuse.union(a, b), "union"), path)
    return catalog.load(spark, path)


@register("k4_save_profile", with_views(["cust_a", "ord_b"], union_all([
    f"select '{t}' as dataset, '{c}' as \"column\", count(*) as n_rows, count(*) - count({c}) as null_count from {t}"
    for t, cols in (("cust_a", ("id", "name", "balance", "segment", "nation")),
                    ("ord_b", ("id", "balance", "segment", "status"))) for c in cols])))
def k4(spark, sf):
    path = scratch_path(spark, "profiles")
    for name in ("ord_b", "cust_a", "ord_b"):  # the second ord_b replaces only its own rows
        found = profile.column_profile(view(spark, sf, name)).select("column", "n_rows", "null_count")
        catalog.save_profile(found.withColumn("dataset", F.lit(name)), path)
    return catalog.load(spark, path).select("dataset", "column", "n_rows", "null_count")


HISTORY_SQL = """select cast(user_id % 10 as varchar) as file_a, cast(user_id % 7 as varchar) as file_b,
    event_type as strategy, ts, value as score from events union all
    select cast(o_custkey % 12 as varchar), cast(o_custkey % 7 as varchar), 'purchase', o_orderdate, o_totalprice
    from orders"""
UPSERT_SQL = f"""select file_a, file_b, strategy, max(ts) as ts, min(ts) as first_seen, max(score) filter (
    where ts = last_ts) as score from (select *, max(ts) over (partition by file_a, file_b, strategy) as last_ts
    from ({HISTORY_SQL})) group by file_a, file_b, strategy"""


def history(spark, sf):
    old = table(spark, sf, "events").selectExpr(
        "cast(user_id % 10 as string) as file_a", "cast(user_id % 7 as string) as file_b", "event_type as strategy",
        "ts", "value as score")
    new = table(spark, sf, "orders").selectExpr(
        "cast(o_custkey % 12 as string) as file_a", "cast(o_custkey % 7 as string) as file_b",
        "'purchase' as strategy", "o_orderdate as ts", "o_totalprice as score")
    return catalog.upsert_history(old, new)


@register("k5_history_upsert", UPSERT_SQL)
def k5(spark, sf):
    return history(spark, sf)


@register("r4_recent_activity", f"""select * from ({UPSERT_SQL})
    order by first_seen desc, file_a, file_b, strategy limit 10""")
def r4(spark, sf):
    return catalog.recent(history(spark, sf))


@register("a12_kpis", f"""select (select count(distinct source) from documents) as total_datasets,
    (select round(avg(q), 1) from (select 100.0e0 * avg(quality) as q from documents join labels using (doc_id)
      group by source)) as avg_quality,
    (select count(*) from ({UPSERT_SQL})) as total_recommendations,
    (select count(distinct o_custkey) from orders) as total_fused""")
def a12(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset"))
    profiles = docs.join(table(spark, sf, "labels"), "doc_id").groupBy("dataset").agg(
        (F.avg("quality") * 100.0).alias("quality_score"))
    return catalog.kpis(docs.select("dataset").distinct(), profiles, history(spark, sf),
                        table(spark, sf, "orders").select("o_custkey").distinct())


# ---------------------------------------------------------------- names and schema

@register("p1_clean_names", """select l_orderkey as l_order_key, l_quantity as qty, l_tax as qty_2, l_discount as "größe_m2",
    l_returnflag as "return" from lineitem""")
def p1(spark, sf):
    li = table(spark, sf, "lineitem")
    messy = li.select("l_orderkey", "l_quantity", "l_tax", "l_discount", "l_returnflag").toDF(
        " L Order Key ", "Qty!", "(qty)", "Größe m2", "Return?")
    return schema.clean_names(messy)


PRESENCE = {"cust_a": ("id", "name", "balance", "segment", "nation"), "ev_null": ("event_id", "user_id", "value",
            "event_type"), "ord_b": ("id", "balance", "segment", "status")}


@register("p2_column_presence", with_views(list(PRESENCE), f"""select "column", string_agg(dataset, ',' order by dataset)
    as datasets, count(*) as n_datasets, cast(sum(n) as bigint) as n_values from ({union_all([
        f"select '{c}' as \"column\", '{t}' as dataset, count({c}) as n from {t}" for t, cs in PRESENCE.items() for c in cs
    ])}) group by "column\""""))
def p2(spark, sf):
    found = schema.column_presence({t: view(spark, sf, t) for t in PRESENCE})
    return found.withColumn("datasets", F.array_join("datasets", ","))


@register("p2_column_sets", with_views(["cust_a", "ord_b"], """select 'id,balance,segment' as common,
    'name,nation' as only_a, 'status' as only_b, 'balance,id,name,nation,segment,status' as all_columns,
    (select count(*) from cust_a) as rows_a, (select count(*) from ord_b) as rows_b"""))
def p2_sets(spark, sf):
    a, b = view(spark, sf, "cust_a"), view(spark, sf, "ord_b")
    found = schema.column_sets(a, b)
    return found.select(*[F.array_join(c, ",").alias(c) for c in found.columns]).withColumns(
        {"rows_a": F.lit(a.count()).cast("bigint"), "rows_b": F.lit(b.count()).cast("bigint")})


@register("p3_align", with_views(["cust_a", "ord_b"], """select balance, id, name, nation, segment,
    cast(null as varchar) as status from cust_a union all select balance, id, null, null, segment, status from ord_b"""))
def p3(spark, sf):
    a, b = schema.align(view(spark, sf, "cust_a"), view(spark, sf, "ord_b"))
    return a.unionByName(b)


@register("p4_suffix_clashes", with_views("ord_b", """select id, balance as balance_b2, segment as segment_b, status
    from ord_b"""))
def p4(spark, sf):
    a = view(spark, sf, "cust_a").withColumn("balance_b", F.lit(0))
    return schema.suffix_clashes(a, view(spark, sf, "ord_b"), keep=["id"])


@register("p5_drop_duplicate_names", "select l_orderkey, l_quantity as x, l_shipdate from lineitem")
def p5(spark, sf):
    return schema.drop_duplicate_names(table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("x"), F.col("l_tax").alias("x"), "l_shipdate", "l_orderkey"))


@register("p6_source_column", "select s_suppkey, s_acctbal, 'supplier' as _source_dataset from supplier")
def p6(spark, sf):
    return schema.with_source(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "supplier")


@register("p7_numeric_columns", "select p_partkey, p_size, p_retailprice from part")
def p7(spark, sf):
    part = table(spark, sf, "part")
    return part.select(*schema.numeric_cols(part))


WORDS = "('true', 'false', 'yes', 'no', '1', '0', 't', 'f', 'y', 'n')"


def label_line(i, c, kind=None):
    if kind:
        return f"select {i} as ordinal, '{c}' as \"column\", '{kind}' as label, count({c}) as n_values from labels_v"
    return (f"select {i} as ordinal, '{c}' as \"column\", case when bool_and(coalesce(regexp_matches({c}, "
            f"'^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), false)) then 'Datetime' when bool_and({c} is null or lower({c}) in {WORDS}) "
            f"and count(distinct {c}) <= 2 then 'Boolean' else 'Categorical/String' end as label, "
            f"count({c}) as n_values from labels_v")


@register("p8_rich_labels", with_views("labels_v", union_all([
    label_line(i, c, k) for i, (c, k) in enumerate((
        ("o_orderkey", "Integer"), ("o_totalprice", "Float"), ("day", None), ("day_gap", None), ("flag", None),
        ("priority", None), ("ts", "Datetime")))])))
def p8(spark, sf):
    return types.rich_labels(view(spark, sf, "labels_v"))


@register("p9_binary_labels", with_views("labels_v", union_all([
    label_line(i, c, k) for i, (c, k) in enumerate((
        ("o_orderkey", "Numeric"), ("o_totalprice", "Numeric"), ("day", "Categorical"), ("day_gap", "Categorical"),
        ("flag", "Categorical"), ("priority", "Categorical"), ("ts", "Categorical")))])))
def p9(spark, sf):
    return types.binary_labels(view(spark, sf, "labels_v"))


# ---------------------------------------------------------------- cleaning

@register("p10_drop_empty_columns", with_views("sparse", "select c_custkey, mostly_null, constant, c_mktsegment from sparse"))
def p10(spark, sf):
    return clean.drop_empty_columns(view(spark, sf, "sparse"))


@register("p11_drop_empty_rows", with_views("gaps", "select * from gaps where value is not null or event_type is not null"))
def p11(spark, sf):
    return clean.drop_empty_rows(view(spark, sf, "gaps"))


@register("p12_drop_unnamed_columns", with_views("gaps", "select value, event_type from gaps"))
def p12(spark, sf):
    return clean.drop_empty_columns(view(spark, sf, "gaps"))


@register("p13_drop_constant", with_views("sparse", "select c_custkey, mostly_null, empty, c_mktsegment from sparse"))
def p13(spark, sf):
    return clean.drop_constant_columns(view(spark, sf, "sparse"))


@register("p14_drop_sparse", with_views("sparse", "select c_custkey, constant, c_mktsegment from sparse"))
def p14(spark, sf):
    return clean.drop_sparse_columns(view(spark, sf, "sparse"))


@register("p15_target_rows", with_views("ev_null", "select * from ev_null where value is not null"))
def p15(spark, sf):
    return clean.target_rows(view(spark, sf, "ev_null"), "value")


@register("p16_outlier_rows", with_views("ev_null", """select ev_null.* from ev_null, (select
    quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from ev_null)
    where value < q1 - 1.5e0 * (q3 - q1) or value > q3 + 1.5e0 * (q3 - q1)"""))
def p16(spark, sf):
    return profile.outlier_rows(view(spark, sf, "ev_null"), "value")


@register("p17_clean_dataset", with_views("gaps", "select value, event_type from gaps where value is not null or "
                                          "event_type is not null"))
def p17(spark, sf):
    return clean.clean_dataset(view(spark, sf, "gaps"))[0]


@register("p17_clean_counts", with_views("gaps", """select count(*) as original_rows, 3 as original_columns,
    count(*) filter (where value is not null or event_type is not null) as n_rows, 2 as n_columns,
    count(*) filter (where value is null and event_type is null) as rows_removed, 1 as columns_removed from gaps"""))
def p17_counts(spark, sf):
    return clean.clean_dataset(view(spark, sf, "gaps"))[1]


# ---------------------------------------------------------------- types

@register("t1_standardize_numeric", with_views("str_num", f"""select l_orderkey, case when regexp_matches(qty, '{NUMBER}')
    then cast(qty as double) end as qty, qty_bad from (select l_orderkey, qty_bad, case when regexp_matches(qty,
    '{NUMBER}') then qty end as qty from str_num)"""))
def t1(spark, sf):
    return types.standardize(view(spark, sf, "str_num"))


@register("t2_standardize_formats", """select o_orderkey, cast(date_trunc('day', o_orderdate) as timestamp) as month_name,
    cast(date_trunc('day', o_orderdate) as timestamp) as short_year, date_trunc('minute', o_orderdate) + interval 9 hour as minutes,
    date_trunc('day', o_orderdate) + interval 1500 millisecond as fractions, date_trunc('day', o_orderdate) - interval 2 hour as zone
    from orders""")
def t2_formats(spark, sf):
    day = F.col("o_orderdate")
    return types.standardize(table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(day, "dd-MMM-yyyy").alias("month_name"), F.date_format(day, "MM/dd/yy").alias("short_year"),
        F.date_format(F.date_trunc("minute", day) + F.expr("interval 9 hours"), "yyyy-MM-dd HH:mm").alias("minutes"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:01.500")).alias("fractions"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00+02:00")).alias("zone")))


@register("t2_standardize_date", with_views("str_date", "select o_orderkey, cast(d as timestamp) as d, d_bad from str_date"))
def t2(spark, sf):
    return types.standardize(view(spark, sf, "str_date"))


@register("t3_numeric_if_clean", """select l_orderkey, cast(cast(l_quantity as int) as double) as clean,
    case when l_orderkey % 20 = 0 then 'n/a' else cast(cast(l_quantity as int) as varchar) end as dirty from lineitem""")
def t3(spark, sf):
    return types.numeric_if_clean(table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "cast(cast(l_quantity as int) as string) as clean",
        "case when l_orderkey % 20 = 0 then 'n/a' else cast(cast(l_quantity as int) as string) end as dirty"))


@register("t4_label_encode", """select c_custkey, dense_rank() over (order by c_name) - 1 as c_name,
    dense_rank() over (order by c_mktsegment) - 1 as c_mktsegment from customer""")
def t4(spark, sf):
    return ml.label_encode(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@register("t4_label_encode_shared", """with w as (select word, dense_rank() over (order by word) - 1 as code from (
    select distinct o_orderpriority as word from orders union select c_mktsegment from customer))
    select o_orderkey as id, code as word from orders join w on o_orderpriority = word union all
    select c_custkey, code from customer join w on c_mktsegment = word""")
def t4_shared(spark, sf):
    a, b = ml.label_encode(
        table(spark, sf, "orders").selectExpr("o_orderkey as id", "o_orderpriority as word"), ["word"],
        other=table(spark, sf, "customer").selectExpr("c_custkey as id", "c_mktsegment as word"))
    return a.unionByName(b)


@register("t5_standard_scale", with_views("li_flat", """select l_linenumber, round((l_quantity - avg(l_quantity) over ())
    / stddev_pop(l_quantity) over (), 4) + 0.0e0 as l_quantity,
    round((l_extendedprice - avg(l_extendedprice) over ()) / stddev_pop(l_extendedprice) over (), 4) + 0.0e0
      as l_extendedprice, l_discount, 0.0e0 as level from li_flat"""))
def t5(spark, sf):
    return rounded(ml.standard_scale(view(spark, sf, "li_flat"), ["l_quantity", "l_extendedprice", "level"]))


# ---------------------------------------------------------------- imputation

def impute_sql(number_fill, text_fill, t="ev_null"):
    mode = f"(select event_type from {t} where event_type is not null group by 1 order by count(*) desc, 1 limit 1)"
    text = mode if text_fill == "mode" else "'Unknown'"
    return with_views(t, f"""select event_id, user_id, round(coalesce(value, (select {number_fill}(value) from {t})), 4)
      as value, coalesce(event_type, {text}) as event_type from {t}""")


@register("i1_impute_mean_mode", impute_sql("avg", "mode"))
def i1(spark, sf):
    return rounded(clean.impute(view(spark, sf, "ev_null")))


@register("i1_impute_zero_unknown", with_views("ev_null", """select event_id, user_id, coalesce(value, 0.0e0) as value,
    coalesce(event_type, 'Unknown') as event_type from ev_null"""))
def i1_zero(spark, sf):
    return clean.impute(view(spark, sf, "ev_null"), "zero", "unknown")


@register("i2_impute_median_mode", impute_sql("median", "mode"))
def i2(spark, sf):
    return rounded(clean.impute(view(spark, sf, "ev_null"), "median", "mode"))


@register("i3_impute_median_unknown", impute_sql("median", "unknown"))
def i3(spark, sf):
    return rounded(clean.impute(view(spark, sf, "ev_null"), "median", "unknown"))


@register("i4_preprocess", with_views("ev_null", """select event_id, user_id, round(value, 4) as value,
    dense_rank() over (order by event_type) - 1 as event_type from (
      select event_id, user_id, coalesce(value, (select median(value) from ev_null)) as value, coalesce(event_type,
        (select event_type from ev_null where event_type is not null group by 1 order by count(*) desc, 1 limit 1))
        as event_type from ev_null)"""))
def i4(spark, sf):
    return rounded(ml.preprocess(view(spark, sf, "ev_null")))
