"""Profiles, statistics, quality scores, row positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendscope import plans, profile, quality, rowindex, variant
from blendscope.session import local_table, scratch_path

from .views import table, union_all, view, with_views

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def rounded(df, digits=4):
    """Float columns rounded, so that the order of summation does not show; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(f"`{n}`"), digits) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def r(expr, digits=4):
    return f"round({expr}, {digits}) + 0.0e0"


NUM_COLS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
EV_COLS = [("event_id", True), ("user_id", True), ("value", True), ("event_type", False)]


def text_mode(c, t):
    return f"(select cast({c} as varchar) from {t} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


def profile_line(i, c, numeric, t):
    """SQL for one row of a column profile."""
    x = f"cast({c} as double)"
    if numeric:
        low = f"(select quantile_cont({x}, 0.25) - 1.5e0 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) from {t})"
        high = f"(select quantile_cont({x}, 0.75) + 1.5e0 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) from {t})"
        outliers = f"count(*) filter (where {x} < {low} or {x} > {high})"
        return f"""select {i} as ordinal, '{c}' as "column", 'Numeric' as type, count(*) as n_rows,
          count(*) - count({c}) as null_count, 100.0e0 * (count(*) - count({c})) / count(*) as null_percent,
          coalesce(avg({x}), 0) as mean, coalesce(stddev_samp({x}), 0) as std, coalesce(min({x}), 0) as min,
          coalesce(max({x}), 0) as max, quantile_cont({x}, 0.25) as q1, quantile_cont({x}, 0.75) as q3,
          count(distinct {c}) as unique_count, cast(null as varchar) as mode, cast(null as bigint) as mode_freq,
          cast(null as double) as mode_percent, {outliers} as outlier_count,
          100.0e0 * {outliers} / count(*) as outlier_percent from {t}"""
    freq = f"coalesce((select count(*) from {t} where {c} is not null group by {c} order by count(*) desc limit 1), 0)"
    none = "cast(null as double)"
    return f"""select {i} as ordinal, '{c}' as "column", 'Categorical' as type, count(*) as n_rows,
      count(*) - count({c}) as null_count, 100.0e0 * (count(*) - count({c})) / count(*) as null_percent,
      {none} as mean, {none} as std, {none} as min, {none} as max, {none} as q1, {none} as q3,
      count(distinct {c}) as unique_count, coalesce({text_mode(c, t)}, 'N/A') as mode, {freq} as mode_freq,
      100.0e0 * {freq} / count(*) as mode_percent, 0 as outlier_count, 0.0e0 as outlier_percent from {t}"""


def profile_sql(t, cols):
    return union_all([profile_line(i, c, numeric, t) for i, (c, numeric) in enumerate(cols)])


def profile_rounded(t, cols):
    doubles = ["null_percent", "mean", "std", "min", "max", "q1", "q3", "mode_percent", "outlier_percent"]
    return (f"select ordinal, \"column\", type, n_rows, null_count, unique_count, mode, mode_freq, outlier_count, "
            f"{', '.join(f'{r(d)} as {d}' for d in doubles)} from ({profile_sql(t, cols)})")


def duplicates_sql(t):
    return f"((select count(*) from {t}) - (select count(*) from (select distinct * from {t})))"


def components_sql(t, cols):
    p = f"({profile_sql(t, cols)})"
    return f"""select 100.0e0 * (1 - sum(null_count) / (count(*) * max(n_rows))) as missing_values,
      100.0e0 * (1 - {duplicates_sql(t)} / max(n_rows)) as duplicate_rows,
      100.0e0 * count(*) filter (where null_count = 0) / count(*) as data_completeness,
      greatest(0, 100.0e0 * (1 - (count(*) filter (where unique_count <= 1) + count(*) filter (
        where type = 'Categorical' and unique_count = n_rows)) / count(*))) as feature_diversity,
      100.0e0 * (1 - sum(outlier_count) / (count(*) * max(n_rows))) as outlier_ratio,
      100.0e0 as data_consistency, 100.0e0 as data_type_validity from {p}"""


COMPONENTS = list(quality.QUALITY_WEIGHTS)
WEIGHTED = " + ".join(f"{w}e0 * {c}" for c, w in quality.QUALITY_WEIGHTS.items())
CUST_COLS = [("id", True), ("name", False), ("balance", True), ("segment", False), ("nation", True)]
ORD_COLS = [("id", True), ("balance", True), ("segment", False), ("status", False)]


@register("a1_shape", "select count(*) as n_rows, 11 as n_cols, count(*) * 11 as n_cells from lineitem")
def a1(spark, sf):
    return profile.shape(spark.read.parquet(f"{sf}/lineitem.parquet"))


@register("a2_null_counts", with_views("ev_null", union_all([
    f"select '{c}' as \"column\", count(*) - count({c}) as null_count, "
    f"{r(f'100.0e0 * (count(*) - count({c})) / count(*)')} as null_percent from ev_null" for c, _ in EV_COLS])))
def a2(spark, sf):
    return rounded(profile.null_counts(view(spark, sf, "ev_null")))


@register("a3_column_profile", with_views("ev_null", profile_rounded("ev_null", EV_COLS)))
def a3(spark, sf):
    return rounded(profile.column_profile(view(spark, sf, "ev_null")))


LINEITEM_COLS = [(c, n) for c, n in (
    ("l_orderkey", 1), ("l_partkey", 1), ("l_suppkey", 1), ("l_linenumber", 1), ("l_quantity", 1),
    ("l_extendedprice", 1), ("l_discount", 1), ("l_tax", 1), ("l_returnflag", 0), ("l_linestatus", 0),
    ("l_shipdate", 0))]


@register("a3_lineitem_profile", profile_rounded("lineitem", LINEITEM_COLS))
def a3_lineitem(spark, sf):
    return rounded(profile.column_profile(spark.read.parquet(f"{sf}/lineitem.parquet")))


@register("a4_iqr_outliers", with_views("ev_null", """select round(q1, 4) as q1, round(q3, 4) as q3, count(*) filter (
    where value < q1 - 1.5e0 * (q3 - q1) or value > q3 + 1.5e0 * (q3 - q1)) as outliers, count(*) as n_rows
    from ev_null, (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from ev_null)
    group by q1, q3"""))
def a4(spark, sf):
    cp = profile.column_profile(view(spark, sf, "ev_null")).where("column = 'value'")
    return rounded(cp.select("q1", "q3", F.col("outlier_count").alias("outliers"), "n_rows"))


@register("a6_modes", with_views("ev_null", union_all([
    f"select '{c}' as \"column\", count(distinct {c}) as unique_count, {text_mode(c, 'ev_null')} as mode, "
    f"(select count(*) from ev_null where {c} is not null group by {c} order by count(*) desc limit 1) as mode_freq "
    "from ev_null" for c in ("event_id", "user_id", "event_type")])))
def a6(spark, sf):
    names = ["event_id", "user_id", "event_type"]
    found = profile.distinct_and_mode(view(spark, sf, "ev_null"), names)
    return local_table(spark, list(enumerate(names)), "ordinal int, column string").join(found, "ordinal").drop("ordinal")


@register("a7_duplicate_rows", with_views("li_dup", f"""select count(*) as n_rows, (select count(*) from (
    select distinct * from li_dup)) as distinct_rows, {duplicates_sql('li_dup')} as duplicate_rows from li_dup"""))
def a7(spark, sf):
    return profile.duplicate_rows(view(spark, sf, "li_dup"))


@register("a7_duplicate_rows_digest", with_views("ev_null", f"""select count(*) as n_rows, (select count(*) from (
    select distinct user_id, event_type from ev_null)) as distinct_rows, count(*) - (select count(*) from (
    select distinct user_id, event_type from ev_null)) as duplicate_rows from ev_null"""))
def a7_digest(spark, sf):
    return profile.duplicate_rows(view(spark, sf, "ev_null").select("user_id", "event_type"), digest=True)


def corr_sql(x, y, t):
    both = f"{x} is not null and {y} is not null"
    return (f"select '{x}' as col_x, '{y}' as col_y, round(case when stddev_pop({x}) filter (where {both}) = 0 or "
            f"stddev_pop({y}) filter (where {both}) = 0 then 0 else corr({y}, {x}) end, 6) + 0.0e0 as r from {t}")


FLAT = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "level"]


@register("a8_correlation", with_views("li_flat", union_all([
    corr_sql(x, y, "li_flat") for x in FLAT for y in FLAT])))
def a8(spark, sf):
    return rounded(profile.correlation(view(spark, sf, "li_flat")), 6)


HEAT = """select bin, "label", "column", round(100.0e0 * nulls / n, 4) as null_percent from (
  select bin, 'Rows ' || min(i) || '-' || max(i) as "label", '{c}' as "column", count(*) as n,
  count(*) filter (where {c} is null) as nulls from (
    select *, cast(least(i // (n_all // least(40, n_all)), least(40, n_all) - 1) as integer) as bin from (
      select *, row_number() over (order by event_id) - 1 as i, count(*) over () as n_all from ev_null))
  group by bin)"""


@register("a9_null_heatmap", with_views("ev_null", union_all([HEAT.format(c=c) for c, _ in EV_COLS])))
def a9(spark, sf):
    return rounded(profile.null_heatmap(view(spark, sf, "ev_null"), ["event_id"]))


@register("a10_class_balance", with_views("ev_null", """select event_type as value, count(*) as n,
    round(100.0e0 * count(*) / (select count(*) from ev_null), 4) as percent from ev_null group by event_type"""))
def a10(spark, sf):
    return rounded(profile.class_balance(view(spark, sf, "ev_null"), "event_type"))


def describe_sql(t, cols):
    return union_all([f"""select '{c}' as "column", count({c}) as count, {r(f'avg({c})')} as mean,
      {r(f'stddev_samp({c})')} as std, {r(f'cast(min({c}) as double)')} as min,
      {', '.join(f'{r(f"quantile_cont(cast({c} as double), 0.{q})")} as q{q}' for q in (25, 50, 75))},
      {r(f'cast(max({c}) as double)')} as max from {t}""" for c in cols])


@register("a11_describe", with_views("ev_null", describe_sql("ev_null", ["event_id", "user_id", "value"])))
def a11(spark, sf):
    return rounded(profile.describe(view(spark, sf, "ev_null")))


@register("a13_missing_summary", with_views("ev_null", f"""select cast(sum(null_count) as bigint) as missing_cells,
    count(*) filter (where null_count > 0) as columns_with_missing,
    count(*) filter (where type = 'Numeric') as numeric_columns from ({profile_sql('ev_null', EV_COLS)})"""))
def a13(spark, sf):
    return profile.missing_summary(profile.column_profile(view(spark, sf, "ev_null")))


SPARSE = ["c_custkey", "mostly_null", "empty", "constant", "c_mktsegment"]


@register("a14_missing_status", with_views("sparse", union_all([
    f"""select '{c}' as "column", n as null_count, round(100.0e0 * n / m, 1) as percent, case
    when round(100.0e0 * n / m, 1) > 50 then 'High Missing' when round(100.0e0 * n / m, 1) > 20 then 'Some Missing'
    else 'Clean' end as status, n > 0.2e0 * m as flagged
    from (select count(*) - count({c}) as n, count(*) as m from sparse)""" for c in SPARSE])))
def a14(spark, sf):
    return profile.missing_status(profile.column_profile(view(spark, sf, "sparse")))


def histogram_sql(last):
    """Bins of ev_null.value; ``last`` says which further values the last bin holds."""
    return with_views("ev_null", f"""select cast(i as integer) as bin, round(low + i * size, 4) as low,
    round(low + i * size + size, 4) as high, (select count(*) from ev_null where value >= low + i * size
      and (value < low + i * size + size or {last})) as n
    from (select min(value) as low, max(value) as top, (max(value) - min(value)) / least(8, sqrt(count(value))) as size,
      ceil(least(8, sqrt(count(value)))) as w from ev_null), range(8) t(i) where i < w""")


@register("a15_histogram", histogram_sql("i = w - 1"))
def a15(spark, sf):
    return rounded(profile.histogram(view(spark, sf, "ev_null"), "value"))


@register("a15_histogram_open", histogram_sql("false"))
def a15_open(spark, sf):
    return rounded(profile.histogram(view(spark, sf, "ev_null"), "value", closed_last=False))


@register("a17_metadata", with_views("labels_v", f"""select count(*) as n_rows, 7 as n_cols,
    'o_orderkey,o_totalprice,day,day_gap,flag,priority,ts' as columns,
    'Integer,Float,Datetime,Categorical/String,Boolean,Categorical/String,Datetime' as labels,
    'o_orderkey,o_totalprice' as numeric_columns, 'day_gap,flag,priority' as categorical_columns,
    {duplicates_sql('labels_v')} as duplicate_rows from labels_v"""))
def a17(spark, sf):
    return plans.metadata(view(spark, sf, "labels_v")).select(
        "n_rows", "n_cols", *[F.array_join(c, ",").alias(c) for c in (
            "columns", "labels", "numeric_columns", "categorical_columns")], "duplicate_rows")


@register("a18_inspect", with_views("gaps", """select count(*) as n_rows, 3 as n_cols,
    'value,event_type,unnamed_1' as columns, 'unnamed_1' as empty_columns,
    count(*) filter (where value is null and event_type is null) as empty_rows from gaps"""))
def a18(spark, sf):
    return profile.inspect(view(spark, sf, "gaps")).select(
        "n_rows", "n_cols", F.array_join("columns", ",").alias("columns"),
        F.array_join("empty_columns", ",").alias("empty_columns"), "empty_rows")


@register("a19_profile", with_views("cust_a", f"""select (select count(*) from cust_a) as n_rows, 5 as n_cols,
    (select cast(sum(null_count) as bigint) from ({profile_sql('cust_a', CUST_COLS)})) as null_cells,
    {', '.join(f'{r(c)} as {c}' for c in COMPONENTS)}, {r(WEIGHTED)} as quality_score
    from ({components_sql('cust_a', CUST_COLS)})"""))
def a19(spark, sf):
    found = plans.profile_table(view(spark, sf, "cust_a"), "cust_a", target="segment", order_by=["id"])
    return rounded(found["profile"].select("n_rows", "n_cols", "null_cells", *COMPONENTS, "quality_score"))


@register("a20_analyze", with_views("sparse", describe_sql("sparse", ["c_custkey", "mostly_null"])))
def a20(spark, sf):
    return rounded(plans.analyze_table(view(spark, sf, "sparse"))["describe"])


# ---------------------------------------------------------------- quality

@register("q8_quality_score", with_views("ord_b", f"""select {', '.join(f'{r(c)} as {c}' for c in COMPONENTS)},
    {r(WEIGHTED)} as quality_score from ({components_sql('ord_b', ORD_COLS)})"""))
def q8(spark, sf):
    return rounded(quality.score(view(spark, sf, "ord_b")))


@register("q8_lineitem_quality", f"""select {', '.join(f'{r(c)} as {c}' for c in COMPONENTS)},
    {r(WEIGHTED)} as quality_score from ({components_sql('lineitem', LINEITEM_COLS)})""")
def q8_lineitem(spark, sf):
    return rounded(quality.score(spark.read.parquet(f"{sf}/lineitem.parquet")))


@register("q1_q5_component_scores", with_views("li_dup", f"""select {', '.join(f'{r(c)} as {c}' for c in COMPONENTS)}
    from ({components_sql('li_dup', [('l_returnflag', 0), ('l_linestatus', 0), ('l_linenumber', 1)])})"""))
def q1_q5(spark, sf):
    return rounded(quality.components(view(spark, sf, "li_dup")))


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@register("q6_content_consistency", with_views("mixed", f"""select round(100.0e0 * (1 - sum(bad) / 4.0e0), 4) as
    data_consistency from (select cast(count(*) filter (where regexp_matches(trim(size_text), '{NUMBER}')) between 1
      and count(size_text) - 1 as integer) as bad from mixed union all
    select cast(count(*) filter (where regexp_matches(trim(p_type), '{NUMBER}')) between 1 and count(p_type) - 1
      as integer) from mixed)"""))
def q6(spark, sf):
    return rounded(quality.components(view(spark, sf, "mixed"), consistency="content").select("data_consistency"))


@register("q7_expected_types", with_views("mixed", """select round(100.0e0 * (1 - cast(count(*) filter (
    where size_text is not null and try_cast(size_text as double) is null) > 0 as integer) / 4.0e0), 4)
    as data_type_validity from mixed"""))
def q7(spark, sf):
    return rounded(quality.components(view(spark, sf, "mixed"), expected_types={
        "size_text": "double", "p_retailprice": "double"}).select("data_type_validity"))


@register("q9_quality_v2", with_views(["cust_a", "ev_null", "str_date"], union_all([
    f"""select '{t}' as dataset, count(*) as n_rows, {r(f"({miss}) / ({w}.0e0 * count(*))")} as missing_ratio,
    {r(f"greatest(0, least(100, 100 - 50.0e0 * ({miss}) / ({w}.0e0 * count(*)) - case when count(*) < 50 then 30 when count(*) < 100 then 15 else 0 end + {tilt}))")}
    as quality_score from {t}""" for t, w, miss, tilt in (
        ("cust_a", 5, "count(*) - count(balance)", 10),
        ("ev_null", 4, "2 * count(*) - count(value) - count(event_type)", 10),
        ("str_date", 3, "0", -10), ("nation", 3, "0", 10), ("region", 2, "0", 10))])))
def q9(spark, sf):
    frames = {t: view(spark, sf, t) for t in ("cust_a", "ev_null", "str_date")} | {
        t: table(spark, sf, t) for t in ("nation", "region")}
    parts = [quality.score_v2(df).select(F.lit(t).alias("dataset"), "*") for t, df in frames.items()]
    return rounded(reduce(DataFrame.unionByName, parts))


# ---------------------------------------------------------------- positions and quantiles

@register("r1_dense_index", with_views("ev_null", """select event_id, user_id,
    row_number() over (order by user_id desc, event_id) - 1 as _idx from ev_null"""))
def r1(spark, sf):
    ev = view(spark, sf, "ev_null")
    return rowindex.dense_index(ev, [F.col("user_id").desc(), "event_id"]).select("event_id", "user_id", "_idx")


@register("r2_rank_quantile", union_all([
    f"select '{c}' as \"column\", {p}e0 as prob, round(quantile_cont(cast({c} as double), {p}), 4) as value from lineitem"
    for c in ("l_extendedprice", "l_quantity", "l_orderkey") for p in (0.01, 0.25, 0.5, 0.9)]))
def r2(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rounded(rowindex.rank_quantile(li, ["l_extendedprice", "l_quantity", "l_orderkey"], [0.01, 0.25, 0.5, 0.9]))


# ---------------------------------------------------------------- values of several types in one column

KINDS = """case when {c} = 'null' then null when regexp_full_match({c}, '-?[0-9]+') then 'integer' when {c} in ('true', 'false')
    then 'boolean' when starts_with({c}, '{{') then 'object' when {c} is not null then 'text' end"""


def json_events(spark, sf):
    return variant.to_variant(view(spark, sf, "ev_json"))


@register("q6_value_kinds", with_views("ev_json", f"""with k as ({union_all([
    f"select '{c}' as \"column\", {KINDS.format(c=c)} as kind from ev_json" for c in ("payload", "plain", "digits")])})
    select "column", kind, count(*) as n, round(100.0e0 * count(*) / sum(count(*)) over (partition by "column"), 4) as percent
    from k where kind is not null group by 1, 2"""))
def q6_kinds(spark, sf):
    return rounded(variant.value_kinds(json_events(spark, sf)))


@register("q6_merged_types", """select * from (values ('payload', 'VARIANT'), ('plain', 'STRING'), ('digits', 'BIGINT')) t("column", type)""")
def q6_types(spark, sf):
    return variant.merged_types(json_events(spark, sf))


@register("q6_variant_consistency", with_views("ev_json", f"""with k as (select ({KINDS.format(c='payload')}) as a,
    ({KINDS.format(c='plain')}) as b, ({KINDS.format(c='digits')}) as c from ev_json)
    select round(100.0e0 * (4 - (case when count(distinct a) > 1 then 1 else 0 end) - (case when count(distinct b) > 1 then 1 else 0 end)
      - (case when count(distinct c) > 1 then 1 else 0 end)) / 4, 4) as data_consistency,
      round(100.0e0 - 100.0e0 * count(*) filter (where a is null) / (4 * count(*)), 4) as missing_values from k"""))
def q6_consistency(spark, sf):
    return rounded(quality.components(json_events(spark, sf)).select("data_consistency", "missing_values"))


# ---------------------------------------------------------------- stored profiles

@register("k4_stored_profile", with_views("ev_null", profile_rounded("ev_null", EV_COLS)))
def k4_stored(spark, sf):
    """Written in two goes; the second refresh reads the second file only."""
    path, store = scratch_path(spark, "source"), scratch_path(spark, "store")
    rows = view(spark, sf, "ev_null")
    for part in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")):
        part.write.mode("append").parquet(path)
        plans.refresh(spark, path, store)
    return rounded(plans.stored_column_profile(spark, path, store))
