"""Joins, unions, fusion, comparison of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendscope import compat, fuse, ml, plans, profile, rowindex, sketch
from blendscope.functions.names import ratio_bound
from blendscope.session import local_table

from .stats import CUST_COLS, ORD_COLS, WEIGHTED, components_sql, corr_sql, profile_sql, rounded
from .views import table, union_all, view, with_views

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def join_sql(a, b, cols_a, cols_b, how):
    """Null-safe join on ``id`` with B's clashing columns suffixed, duplicates removed."""
    key = "coalesce(a.id, b.id) as id"
    left = [f"a.{c}" for c in cols_a]
    right = [f"b.{c} as {c}_b" if c in cols_a else f"b.{c}" for c in cols_b]
    return (f"select distinct {', '.join([key, *left, *right])} from {a} a {how} join {b} b "
            "on a.id is not distinct from b.id")


A_COLS, B_COLS = ["name", "balance", "segment", "nation"], ["balance", "segment", "status"]


def register_join(name, how, sql_how):
    @register(name, with_views(["cust_a", "ord_b"], join_sql("cust_a", "ord_b", A_COLS, B_COLS, sql_how)))
    def run(spark, sf):
        return fuse.join(view(spark, sf, "cust_a"), view(spark, sf, "ord_b"), "id", how)


for _name, _how, _sql in (("j1_inner", "inner", "inner"), ("j2_left", "left", "left"),
                          ("j3_right", "right", "right"), ("j4_outer", "outer", "full outer")):
    register_join(_name, _how, _sql)


@register("j4_outer_null_keys", with_views(["cust_null_key", "supp_null_key"], join_sql(
    "cust_null_key", "supp_null_key", ["balance"], ["balance", "nation"], "full outer")))
def j4_null(spark, sf):
    return fuse.join(view(spark, sf, "cust_null_key"), view(spark, sf, "supp_null_key"), "id", "outer")


@register("j5_find_key", """select 'cust_a & ord_b' as pair, 'id' as key_column union all
    select 'names', case when count(distinct c_name) = count(*) then 'label' end from customer union all
    select 'segments', case when count(distinct c_mktsegment) = count(*) then 'segment' end from customer""")
def j5(spark, sf):
    cust = table(spark, sf, "customer")
    names = cust.selectExpr("c_mktsegment as segment", "c_name as label", "c_acctbal as amount")
    other = cust.selectExpr("c_name as label", "c_nationkey as amount", "c_mktsegment as segment")
    rows = [
        ("cust_a & ord_b", compat.find_key(view(spark, sf, "cust_a"), view(spark, sf, "ord_b"))),
        ("names", compat.find_key(names, other)),
        ("segments", compat.find_key(names.select("segment"), other.select("segment"))),
    ]
    return local_table(spark, rows, "pair string, key_column string")


MANY = """t1 as (select c_custkey as id, c_acctbal as balance, c_nationkey as nation from customer),
  t2 as (select o_custkey + 100 as id, min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1),
  t3 as (select s_suppkey * 10 as id, s_acctbal as credit, s_name as supplier from supplier)"""


def many(spark, sf):
    orders = table(spark, sf, "orders")
    return {
        "t1": table(spark, sf, "customer").selectExpr("c_custkey as id", "c_acctbal as balance", "c_nationkey as nation"),
        "t2": orders.groupBy((F.col("o_custkey") + 100).alias("id")).agg(
            F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")),
        "t3": table(spark, sf, "supplier").selectExpr("s_suppkey * 10 as id", "s_acctbal as credit", "s_name as supplier"),
    }


MERGED = f"""with {MANY} select coalesce(t1.id, t2.id, t3.id) as id, balance, nation, low, high, credit, supplier
  from t1 full join t2 on t1.id is not distinct from t2.id
  full join t3 on coalesce(t1.id, t2.id) is not distinct from t3.id"""


@register("j6_fuse_many", MERGED)
def j6(spark, sf):
    return fuse.merge_many(many(spark, sf))


@register("j6_fuse_many_per_column", """with a as (select s_nationkey as id, s_acctbal as balance from supplier),
    b as (select n_nationkey as id, n_name, n_regionkey from nation union all
      select n_nationkey, lower(n_name), n_regionkey + 10 from nation)
    select coalesce(x.id, c.id) as id, balance, x.n_name, c.n_regionkey from (
      select coalesce(a.id, b.id) as id, balance, n_name from a full join b on a.id is not distinct from b.id) x
    full join b c on x.id is not distinct from c.id""")
def j6_per_column(spark, sf):
    nation = table(spark, sf, "nation")
    twice = nation.selectExpr("n_nationkey as id", "n_name", "n_regionkey").unionByName(
        nation.selectExpr("n_nationkey as id", "lower(n_name) as n_name", "n_regionkey + 10 as n_regionkey"))
    return fuse.merge_many({"a": table(spark, sf, "supplier").selectExpr("s_nationkey as id", "s_acctbal as balance"),
                            "b": twice}, mode="per_column")


@register("j6_fuse_many_filled", f"""with merged as ({MERGED})
    select cast(id as double) as id, round(coalesce(balance, (select median(balance) from merged)), 4) as balance,
      round(coalesce(nation, (select median(nation) from merged)), 4) as nation,
      round(coalesce(low, (select median(low) from merged)), 4) as low,
      round(coalesce(high, (select median(high) from merged)), 4) as high,
      round(coalesce(credit, (select median(credit) from merged)), 4) as credit,
      coalesce(supplier, 'Unknown') as supplier from merged""")
def j6_filled(spark, sf):
    filled, _ = fuse.fuse_many(many(spark, sf))
    return rounded(filled.withColumn("id", F.col("id").cast("double")))


@register("k6_fusion_metadata", f"""select 't1,t2,t3' as original_datasets, count(*) as total_rows, 7 as total_columns,
    'id,balance,nation,low,high,credit,supplier' as columns from ({MERGED})""")
def k6(spark, sf):
    _, meta = fuse.fuse_many(many(spark, sf))
    return meta.select(F.array_join("original_datasets", ",").alias("original_datasets"), "total_rows", "total_columns",
                       F.array_join("columns", ",").alias("columns"))


@register("j7_concat", with_views(["cust_a", "ord_pos"], """select a.id, a.name, a.balance, a.segment, a.nation,
    b.id as id_b, b.balance as balance_b, b.status
    from (select *, row_number() over (order by id) as rn from cust_a) a
    full join (select *, row_number() over (order by id) as rn from ord_pos) b on a.rn = b.rn"""))
def j7(spark, sf):
    return fuse.concat(view(spark, sf, "cust_a"), view(spark, sf, "ord_pos"), ["id"], ["id"])


def estimate_sql(how):
    a, b = "select distinct * from cust_a", "select distinct * from ord_b"
    cells = " + ".join(f"(count(*) - count({c}))" for c in ("id", "name", "balance", "segment", "nation", "balance_b", "segment_b", "status"))
    sql = {"outer": "full outer"}.get(how, how)
    return f"""select '{how}' as join_type, cast(count(*) as bigint) as n_rows, cast({cells} as bigint) as null_cells, (select max(n) from (
      select count(*) as n from j group by id)) as largest_key_rows from j""", f"""j as (select coalesce(a.id, b.id) as id, name,
      a.balance, a.segment, nation, b.balance as balance_b, b.segment as segment_b, status
      from ({a}) a {sql} join ({b}) b on a.id is not distinct from b.id)"""


def register_estimate(how):
    body, joined = estimate_sql(how)

    @register(f"j_estimate_{how}", with_views(["cust_a", "ord_b"], f"with {joined} {body}"))
    def run(spark, sf):
        found = fuse.estimate(view(spark, sf, "cust_a"), view(spark, sf, "ord_b"), "id", how).drop("largest_key")
        return found.select("join_type", *[F.col(c).cast("bigint") for c in ("n_rows", "null_cells", "largest_key_rows")])


for _how in ("inner", "left", "right", "outer"):
    register_estimate(_how)


DATASETS = "select source || '/' || lang as dataset, count(*) as n from documents group by 1"


@register("j8_pairs", f"""with d as (select dataset, n, row_number() over (order by dataset) as i from ({DATASETS}))
    select a.dataset as dataset_a, b.dataset as dataset_b, a.n as n_a, b.n as n_b from d a join d b on a.i < b.i""")
def j8(spark, sf):
    sets = table(spark, sf, "documents").groupBy(F.concat_ws("/", "source", "lang").alias("dataset")).agg(
        F.count("*").alias("n"))
    placed = rowindex.dense_index(sets, ["dataset"], "ordinal")
    found = compat.pairs(placed.select("dataset", "ordinal"))
    return found.join(placed.select(F.col("dataset").alias("dataset_a"), F.col("n").alias("n_a")), "dataset_a").join(
        placed.select(F.col("dataset").alias("dataset_b"), F.col("n").alias("n_b")), "dataset_b")


def name_pairs(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand")), " ").alias("names_a"),
        F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ").alias("names_b"))


@register("j9_name_similarity")
def j9(spark, sf):
    return compat.name_similarity(name_pairs(spark, sf)).select("p_partkey", "column_name_similarity")


SHARED = """list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: least(length(x) - length(replace(x, c, '')),
    length(y) - length(replace(y, c, '')))))"""


@register("j9_name_bound", f"""select p_partkey, i as place, round(max(2.0e0 * {SHARED} / (length(x) + length(y))), 6) + 0.0e0 as bound
    from (select p_partkey, unnest(string_split(lower(p_name || ' ' || p_brand), ' ')) as x,
        generate_subscripts(string_split(lower(p_name || ' ' || p_brand), ' '), 1) as i from part) a
    join (select p_partkey as k, unnest(string_split(lower(p_type || ' ' || p_name), ' ')) as y from part) b
      on p_partkey = k group by 1, 2""")
def j9_bound(spark, sf):
    """What the search for the best ratio prunes by: never below the ratio itself."""
    best = F.transform("names_a", lambda x: F.array_max(F.transform("names_b", lambda y: ratio_bound(x, y))))
    return name_pairs(spark, sf).select("p_partkey", F.posexplode(best).alias("place", "bound")).select(
        "p_partkey", (F.col("place") + 1).cast("bigint").alias("place"), (F.round("bound", 6) + 0.0).alias("bound"))


@register("j9_name_levenshtein", """select p_partkey, round(100.0e0 * avg(best), 4) as column_name_similarity from (
    select p_partkey, i, max(greatest(0.0e0, 1 - levenshtein(x, y) / greatest(length(x), length(y), 1)::double)) as best
    from (select p_partkey, unnest(string_split(lower(p_name || ' ' || p_brand), ' ')) as x,
        generate_subscripts(string_split(lower(p_name || ' ' || p_brand), ' '), 1) as i from part) a
    join (select p_partkey as k, unnest(string_split(lower(p_type || ' ' || p_name), ' ')) as y from part) b
      on p_partkey = k group by 1, 2) group by 1""")
def j9_lev(spark, sf):
    return rounded(compat.name_levenshtein(name_pairs(spark, sf)).select("p_partkey", "column_name_similarity"))


@register("j11_fuse_stats", with_views(["cust_a", "ord_b"], f"""with fused as (
    {join_sql('cust_a', 'ord_b', A_COLS, B_COLS, 'left')})
    select 'left_join' as strategy, 'id' as primary_key, (select count(*) from cust_a) as rows_before_a,
      (select count(*) from ord_b) as rows_before_b, 5 as cols_before_a, 4 as cols_before_b, count(*) as rows_after,
      8 as cols_after, cast(0 as bigint) as missing_cells, 0.0e0 as missing_ratio, cast(0 as bigint) as duplicate_rows
    from fused"""))
def j11(spark, sf):
    _, stats, _ = plans.fuse_tables(view(spark, sf, "cust_a"), view(spark, sf, "ord_b"), "left_join", impute_gaps=True)
    return stats


@register("a16_fused_stats", with_views(["cust_a", "ord_b"], f"""with fused as (
    {join_sql('cust_a', 'ord_b', A_COLS, B_COLS, 'right')}), gaps as (select cast(count(*) * 8 - count(id) - count(name)
      - count(balance) - count(segment) - count(nation) - count(balance_b) - count(segment_b) - count(status) as bigint)
      as missing, count(*) as n from fused)
    select 'right_join' as strategy, 'id' as primary_key, (select count(*) from cust_a) as rows_before_a,
      (select count(*) from ord_b) as rows_before_b, 5 as cols_before_a, 4 as cols_before_b, n as rows_after,
      8 as cols_after, missing as missing_cells, round(100.0e0 * missing / (n * 8), 4) as missing_ratio,
      cast(0 as bigint) as duplicate_rows from gaps"""))
def a16(spark, sf):
    a, b = view(spark, sf, "cust_a"), view(spark, sf, "ord_b")
    return rounded(fuse.stats(a, b, fuse.join(a, b, "id", "right"), "right_join", "id"))


def filled(c, t, numeric):
    if numeric:
        return f"round(coalesce(cast({c} as double), (select avg({c}) from {t})), 4) + 0.0e0 as {c}"
    return (f"coalesce({c}, (select {c} from {t} where {c} is not null group by {c} "
            f"order by count(*) desc, {c} limit 1)) as {c}")


@register("j11_fuse_left_imputed", with_views(["cust_a", "ord_b"], f"""with fused as (
    {join_sql('cust_a', 'ord_b', A_COLS, B_COLS, 'left')}) select id, name, {filled('balance', 'fused', True)}, segment,
    nation, {filled('balance_b', 'fused', True)}, {filled('segment_b', 'fused', False)},
    {filled('status', 'fused', False)} from fused"""))
def j11_rows(spark, sf):
    fused, _, _ = plans.fuse_tables(view(spark, sf, "cust_a"), view(spark, sf, "ord_b"), "left_join", impute_gaps=True)
    return rounded(fused)


# ---------------------------------------------------------------- unions

LI = ["l_discount", "l_extendedprice", "l_linenumber", "l_quantity", "l_returnflag"]


@register("u1_union", with_views(["li_a", "li_b"], f"""select {', '.join(LI)} from li_a union
    select {', '.join(LI)} from li_b"""))
def u1(spark, sf):
    return fuse.union(view(spark, sf, "li_a"), view(spark, sf, "li_b"))


@register("u1_union_mixed_types", with_views(["cust_a", "ord_pos"], """select balance, cast(id as varchar) as id, name,
    nation, segment, cast(null as varchar) as status from cust_a union select balance, 'o' || cast(id as varchar), null,
    null, null, status from ord_pos"""))
def u1_mixed(spark, sf):
    return fuse.union(view(spark, sf, "cust_a"), view(spark, sf, "ord_pos").withColumn(
        "id", F.concat(F.lit("o"), F.col("id").cast("string"))))


@register("u2_union_all_named", """select c_custkey, c_acctbal, cast(null as bigint) as s_suppkey,
    cast(null as double) as s_acctbal, 'customer' as _source_dataset from customer union all
    select null, null, s_suppkey, s_acctbal, 'supplier' from supplier""")
def u2(spark, sf):
    return fuse.merge_many({"customer": table(spark, sf, "customer").select("c_custkey", "c_acctbal"),
                            "supplier": table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")})


@register("u3_fused_training_set", with_views(["cust_a", "ord_b"], """select id, segment, balance from cust_a
    where balance is not null union all select id, segment, balance from ord_b where balance is not null"""))
def u3(spark, sf):
    return ml.fused_training_set(view(spark, sf, "cust_a"), view(spark, sf, "ord_b"), "balance")


@register("u4_distinct_rows", with_views("li_dup", "select distinct * from li_dup"))
def u4(spark, sf):
    return view(spark, sf, "li_dup").distinct()


OVERLAP = """select count(distinct v) filter (where s = 'a') as n_a, count(distinct v) filter (where s = 'b') as n_b,
    count(distinct v) filter (where s = 'a') + count(distinct v) filter (where s = 'b') - count(distinct v) as n_both,
    count(distinct v) as n_either from (select {c} as v, 'a' as s from {a} union all select {c}, 'b' from {b})"""


@register("u5_key_overlap", with_views(["cust_a", "ord_b"], OVERLAP.format(c="id", a="cust_a", b="ord_b")))
def u5(spark, sf):
    return compat.key_overlap(view(spark, sf, "cust_a"), view(spark, sf, "ord_b"), "id")


@register("a5_row_overlap", with_views(["cust_a", "ord_b"], f"""select round(100.0e0 * n_both / n_either, 4) as
    row_overlap, 'Matched primary key ''id'' with ' || n_both || ' overlapping records.' as key_info
    from ({OVERLAP.format(c='id', a='cust_a', b='ord_b')})"""))
def a5(spark, sf):
    return rounded(compat.row_overlap(view(spark, sf, "cust_a"), view(spark, sf, "ord_b"), "id"))


CATALOG = {"cust_a": ["id", "balance", "segment", "nation"], "ord_b": ["id", "balance", "segment", "status"],
           "supp_null_key": ["id", "balance", "nation"], "li_dup": ["l_returnflag", "l_linestatus", "l_linenumber"]}
CATALOG_PAIRS = [(x, y, c) for i, x in enumerate(CATALOG) for y in list(CATALOG)[i + 1:] for c in CATALOG[x] if c in CATALOG[y]]


@register("u5_catalog_overlap", with_views(list(CATALOG), union_all([
    f"select '{x}' as dataset_a, '{y}' as dataset_b, '{c}' as \"column\", (select count(distinct a.{c}) from {x} a join {y} b on a.{c} = b.{c}) as n"
    for x, y, c in CATALOG_PAIRS])))
def catalog_overlap(spark, sf):
    tables = {n: view(spark, sf, n) for n in CATALOG}
    shared = compat.shared_values(compat.value_index(tables, CATALOG))
    names = F.array(*[F.lit(n) for n in CATALOG])
    pairs = local_table(spark, [(x, y, c) for x, y, c in CATALOG_PAIRS], "dataset_a string, dataset_b string, column string")
    found = shared.where("a < b").groupBy(F.get(names, "a").alias("dataset_a"), F.get(names, "b").alias("dataset_b"), "column").agg(F.sum("n").alias("n"))
    return F.broadcast(pairs).join(found, ["dataset_a", "dataset_b", "column"], "left").select(
        "dataset_a", "dataset_b", "column", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


SKETCHED = {"cust_a": ["id", "name", "balance", "segment"], "ord_b": ["id", "balance", "segment", "status"],
            "li_a": ["l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]}
SKETCH_LG = 10  # 1,024 values a sketch, so that larger columns are estimated at every scale


@register("u5_sketch_distinct", with_views(list(SKETCHED), union_all([
    f"select '{t}' as dataset, '{c}' as \"column\", count(distinct {c}) as n, true as within, count(distinct {c}) <= {1 << SKETCH_LG} as exact from {t}"
    for t, cols in SKETCHED.items() for c in cols])))
def sketch_distinct(spark, sf):
    """Distinct values by sketches: do the stated bounds hold the exact count, and are small counts exact?"""
    out = []
    for t, cols in SKETCHED.items():
        df = view(spark, sf, t)
        exact = local_table(spark, list(profile.distinct_counts(df, cols).items()), "column string, n bigint")
        seen = sketch.distinct(sketch.states(df, cols, SKETCH_LG)).select("column", "low", "high")
        out.append(F.broadcast(exact).join(seen, "column").select(
            F.lit(t).alias("dataset"), "column", "n", F.col("n").between(F.col("low"), F.col("high")).alias("within"),
            (F.col("low") == F.col("high")).alias("exact")))
    return reduce(DataFrame.unionByName, out)


@register("u5_sketch_overlap", with_views(list(CATALOG), union_all([
    f"select '{x}' as dataset_a, '{y}' as dataset_b, '{c}' as \"column\", (select count(distinct a.{c}) from {x} a join {y} b on a.{c} = b.{c}) as n, "
    "true as within" for x, y, c in CATALOG_PAIRS])))
def sketch_overlap(spark, sf):
    """Common values of all pairs of a catalog by sketches: do the stated bounds hold the exact number?"""
    tables = {n: view(spark, sf, n) for n in CATALOG}
    seen = sketch.catalog_overlap(tables, CATALOG, SKETCH_LG).select("dataset_a", "dataset_b", "column", "low", "high")
    return catalog_overlap(spark, sf).join(seen, ["dataset_a", "dataset_b", "column"], "left").select(
        "dataset_a", "dataset_b", "column", "n", F.col("n").between(F.col("low"), F.col("high")).alias("within"))


LI_NUM = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]


def no_key_overlap(a, b, cols):
    return union_all([f"select n_both / greatest(n_a, n_b)::double as share from ({OVERLAP.format(c=c, a=a, b=b)})"
                      for c in cols])


@register("a5_row_overlap_no_key", with_views(["li_a", "li_c"], f"""select round(100.0e0 * avg(share), 4) as row_overlap,
    'No common identifier column found.' as key_info from ({no_key_overlap('li_a', 'li_c', LI_NUM)})"""))
def a5_no_key(spark, sf):
    return rounded(compat.row_overlap(view(spark, sf, "li_a"), view(spark, sf, "li_c")))


# ---------------------------------------------------------------- comparison

def corr_distance(a, b, cols):
    pairs = [(x, y) for x in cols for y in cols]
    one = {t: union_all([corr_sql(x, y, t).replace(", 6) + 0.0e0 as r", ", 15) as r") for x, y in pairs])
           for t in (a, b)}
    return (f"(select greatest(0, 100.0e0 * (1 - avg(abs(p.r - q.r)) / 2)) from ({one[a]}) p join ({one[b]}) q "
            "using (col_x, col_y))")


@register("c7_corr_similarity", with_views(["li_a", "li_c"], f"""select round({corr_distance('li_a', 'li_c', LI_NUM)},
    4) as correlation_similarity, (select count(*) from li_a) as n_a, (select count(*) from li_c) as n_c"""))
def c7(spark, sf):
    a, b = view(spark, sf, "li_a"), view(spark, sf, "li_c")
    return rounded(local_table(spark, [(compat.correlation_similarity(a, b), a.count(), b.count())],
                               "correlation_similarity double, n_a bigint, n_c bigint"))


MISSING = """select '{c}' as "column", count(*) filter (where a.event_id is not null and a.{c} is null) as nulls_a,
    count(*) filter (where b.event_id is not null and b.{c} is null) as nulls_b,
    count(*) filter (where a.event_id is not null and b.event_id is not null and a.{c} is null and b.{c} is null)
      as nulls_both
    from (select *, row_number() over (order by event_id) as rn from ev_null) a
    full join (select *, row_number() over (order by event_id) as rn from ord_null) b on a.rn = b.rn"""


@register("r3_missing_overlap", with_views(["ev_null", "ord_null"], f"""select "column", nulls_a, nulls_b, nulls_both,
    round(case when nulls_a + nulls_b - nulls_both = 0 then 100 else 100.0e0 * nulls_both
      / (nulls_a + nulls_b - nulls_both) end, 4) as overlap
    from ({union_all([MISSING.format(c=c) for c in ('event_id', 'value')])})"""))
def r3(spark, sf):
    return rounded(compat.missing_overlap(
        view(spark, sf, "ev_null"), view(spark, sf, "ord_null"), ["event_id"], ["event_id"]))


@register("r3_missing_overlap_parity", with_views(["ev_null", "ord_null"], f"""select m."column", nulls_a, nulls_b,
    nulls_both, round(case when nulls_a + nulls_b - tail - nulls_both = 0 then 100 else 100.0e0 * nulls_both
      / (nulls_a + nulls_b - tail - nulls_both) end, 4) as overlap
    from ({union_all([MISSING.format(c=c) for c in ('event_id', 'value')])}) m join (
      select 'value' as "column", count(*) filter (where value is null and rn > (select count(*) from ev_null)) as tail
      from (select *, row_number() over (order by event_id) as rn from ord_null) union all select 'event_id', 0) t
    on m."column" = t."column\""""))
def r3_parity(spark, sf):
    return rounded(compat.missing_overlap(
        view(spark, sf, "ev_null"), view(spark, sf, "ord_null"), ["event_id"], ["event_id"], parity=True))


# Without the name similarity, which SQL cannot state; c9_compat_score has the whole row.
@register("c9_compare_keyed", with_views(["cust_a", "ord_b"], f"""select 50.0e0 as schema_similarity,
    100.0e0 as dtype_compatibility, 60.0e0 as common_columns_ratio, 20.0e0 as unique_feature_gain,
    round(100.0e0 * n_both / n_either, 4) as row_overlap,
    round({corr_distance('cust_a', 'ord_b', ['id', 'balance'])}, 4) as correlation_similarity, 'id' as primary_key,
    'Matched primary key ''id'' with ' || n_both || ' overlapping records.' as key_info,
    'id,balance,segment' as common_columns, 'status' as new_columns
    from ({OVERLAP.format(c='id', a='cust_a', b='ord_b')})"""))
def c9_keyed(spark, sf):
    return rounded(compat.compare(view(spark, sf, "cust_a"), view(spark, sf, "ord_b")).select(
        "schema_similarity", "dtype_compatibility", "common_columns_ratio", "unique_feature_gain", "row_overlap",
        "correlation_similarity", "primary_key", "key_info", F.array_join("common_columns", ",").alias("common_columns"),
        F.array_join("new_columns", ",").alias("new_columns")))


# Every column of li_c occurs in li_a, so the name similarity is 100 and the whole row can be stated in SQL.
@register("c9_compat_score", with_views(["li_a", "li_c"], f"""select schema_similarity, column_name_similarity,
    dtype_compatibility, common_columns_ratio, unique_feature_gain, round(row_overlap, 4) as row_overlap,
    round(correlation_similarity, 4) as correlation_similarity, missing_value_overlap,
    round(0.25e0 * schema_similarity + 0.15e0 * (dtype_compatibility + common_columns_ratio + column_name_similarity
      + row_overlap + correlation_similarity), 4) as compatibility_score
    from (select 80.0e0 as schema_similarity, 100.0e0 as column_name_similarity, 100.0e0 as dtype_compatibility,
      80.0e0 as common_columns_ratio, 25.0e0 as unique_feature_gain,
      (select 100.0e0 * avg(share) from ({no_key_overlap('li_a', 'li_c', LI_NUM)})) as row_overlap,
      {corr_distance('li_a', 'li_c', LI_NUM)} as correlation_similarity, 75.0e0 as missing_value_overlap)"""))
def c9_score(spark, sf):
    return rounded(compat.compare(view(spark, sf, "li_c"), view(spark, sf, "li_a")).select(
        "schema_similarity", "column_name_similarity", "dtype_compatibility", "common_columns_ratio",
        "unique_feature_gain", "row_overlap", "correlation_similarity", "missing_value_overlap", "compatibility_score"))


@register("c10_feature_overlap", with_views(["cust_a", "ord_b"], """select 50.0e0 as overlap_percentage,
    100.0e0 as type_match_percentage, 'id,balance,segment' as common_columns, 'name,nation' as unique_to_a,
    'status' as unique_to_b, (select count(*) from cust_a) as n_a, (select count(*) from ord_b) as n_b"""))
def c10(spark, sf):
    a, b = view(spark, sf, "cust_a"), view(spark, sf, "ord_b")
    found = compat.feature_overlap(a, b).select(
        "overlap_percentage", "type_match_percentage", *[F.array_join(c, ",").alias(c) for c in (
            "common_columns", "unique_to_a", "unique_to_b")])
    return found.withColumns({"n_a": F.lit(a.count()).cast("bigint"), "n_b": F.lit(b.count()).cast("bigint")})


def paired_corr(x, y):
    both = f"a.{x} is not null and b.{y} is not null"
    return (f"select case when stddev_pop(a.{x}) filter (where {both}) > 0 and stddev_pop(b.{y}) filter (where {both}) "
            f"> 0 then (1 - abs(corr(b.{y}, a.{x}))) * 100 end as s from a join b on a.rn = b.rn")


@register("c11_complementarity", with_views(["ev_null", "ord_null"], f"""with
    a as (select *, row_number() over (order by event_id) as rn from ev_null),
    b as (select *, row_number() over (order by event_id) as rn from ord_null)
    select round(least(100, coalesce(avg(s), 50) + 30), 4) as complementarity_score, 2 as unique_cols_a,
      1 as unique_cols_b, cast(count(s) as integer) as compared_pairs
    from ({union_all([paired_corr(x, y) for x in ('event_id', 'user_id', 'value') for y in ('event_id', 'value')])})"""))
def c11(spark, sf):
    return rounded(compat.complementarity(
        view(spark, sf, "ev_null"), view(spark, sf, "ord_null"), ["event_id"], ["event_id"]))


WIDE = ("id", "group_id", "mix", "price", "trend")


@register("c11_complementarity_wide", with_views(["ord_wide", "cust_wide"], f"""with
    a as (select *, row_number() over (order by id) as rn from ord_wide),
    b as (select *, row_number() over (order by id) as rn from cust_wide)
    select round(avg(s), 4) as complementarity_score, 0 as unique_cols_a, 0 as unique_cols_b,
      cast(count(s) as integer) as compared_pairs
    from ({union_all([paired_corr(x, y) for x in WIDE for y in WIDE])})"""))
def c11_wide(spark, sf):
    return rounded(compat.complementarity(view(spark, sf, "ord_wide"), view(spark, sf, "cust_wide"), ["id"], ["id"]))


@register("c1_c5_compare_catalog")
def compare_catalog(spark, sf):
    tables = {n: view(spark, sf, n) for n in ("cust_a", "ord_b", "supp_null_key")}
    return rounded(compat.compare_all(tables, {"cust_a": ["id"], "ord_b": ["id", "balance"], "supp_null_key": ["balance"]}))


# ---------------------------------------------------------------- end to end

@register("e4_recommend_tables", with_views(["cust_a", "ord_b"], f"""with qa as (select {WEIGHTED} as q from (
      {components_sql('cust_a', CUST_COLS)})),
    qb as (select {WEIGHTED} as q from ({components_sql('ord_b', ORD_COLS)})),
    o as ({OVERLAP.format(c='id', a='cust_a', b='ord_b')})
    select round(qa.q, 2) as q_a, round(qb.q, 2) as q_b, (select count(*) from cust_a) as num_rows_a,
      (select count(*) from ord_b) as num_rows_b,
      (select cast(sum(null_count) as bigint) from ({profile_sql('cust_a', CUST_COLS)})) as null_cells_a,
      (select cast(sum(null_count) as bigint) from ({profile_sql('ord_b', ORD_COLS)})) as null_cells_b,
      round(100.0e0 * n_both / n_either, 2) as row_overlap, 'FUSE' as recommendation,
      case when 100.0e0 * n_both / n_either > 75 then 'inner_join' when 100.0e0 * n_both / n_either > 20 then 'left_join'
        else 'outer_join' end as suggested_strategy from qa, qb, o"""))
def e4_tables(spark, sf):
    found = plans.recommend_pair(view(spark, sf, "cust_a"), view(spark, sf, "ord_b"))
    return found.select("q_a", "q_b", "num_rows_a", "num_rows_b", "null_cells_a", "null_cells_b", "row_overlap",
                        "recommendation", "suggested_strategy")

