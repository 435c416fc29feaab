"""Estimates, recommendations, learning, reports.

The rules work on a table of pairs. Here one pair is made from every order by plain arithmetic, so that
all branches of the rules occur and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from blendscope import compat, ml, plans, recommend, report, rowindex
from blendscope.operators.quality import QUALITY_WEIGHTS

from .stats import rounded
from .views import table, union_all, view, with_views

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def cents(expr, span, start=0):
    """A value with two decimals between ``start`` and ``start + span``."""
    return f"({start * 100} + ({expr}) % {span * 100 + 1}) / 100.0e0"


PAIRS = {
    "dataset_a": "concat('a', o_custkey)", "dataset_b": "concat('b', o_orderkey)",
    "q_a": cents("o_orderkey * 7", 60, 40), "q_b": cents("o_custkey * 13 + o_orderkey", 80, 20),
    "schema_similarity": cents("o_orderkey * 37", 100), "column_name_similarity": cents("o_orderkey * 41", 100),
    "dtype_compatibility": cents("o_custkey * 43", 100), "common_columns_ratio": cents("o_custkey * 47", 100),
    "unique_feature_gain": cents("o_orderkey * 59", 100), "row_overlap": cents("o_custkey * 71 + o_orderkey * 3", 100),
    "correlation_similarity": cents("o_orderkey * 61", 100), "missing_value_overlap": cents("o_orderkey * 67", 100),
    "primary_key": "case o_orderkey % 4 when 1 then 'id' when 2 then 'user_id' when 3 then 'order_code' end",
    "has_primary_key": "case when o_orderkey % 4 = 0 then 0.0e0 else 1.0e0 end",
    "comp_score": cents("o_orderkey * 53 + o_custkey", 100),
    "missing_score_a": cents("o_orderkey * 11", 20, 80), "missing_score_b": cents("o_orderkey * 17", 20, 80),
    "dup_score_a": cents("o_orderkey * 19", 10, 90), "dup_score_b": cents("o_orderkey * 23", 10, 90),
    "completeness_a": cents("o_custkey * 29", 20, 80), "completeness_b": cents("o_custkey * 31", 20, 80),
    "diversity_a": cents("o_custkey * 3", 20, 80), "diversity_b": cents("o_custkey * 5", 20, 80),
    "outlier_score_a": cents("o_orderkey * 2", 20, 80), "outlier_score_b": cents("o_orderkey * 8", 20, 80),
    "num_rows_a": "100 + (o_custkey * 7) % 9000", "num_rows_b": "100 + o_orderkey % 7919",
    "num_cols_a": "5 + o_custkey % 40", "num_cols_b": "5 + o_orderkey % 37",
    "null_cells_a": "(o_custkey * 31) % 500", "null_cells_b": "(o_orderkey * 17) % 500",
    "only_a": "5 + o_custkey % 40 - 1 - o_orderkey % 5", "only_b": "5 + o_orderkey % 37 - 1 - o_orderkey % 5",
    "all_columns": "5 + o_custkey % 40 + 5 + o_orderkey % 37 - 1 - o_orderkey % 5",
}
PAIRS_SQL = f"pairs as (select {', '.join(f'{e} as {c}' for c, e in PAIRS.items())} from orders)"


def pairs(spark, sf):
    return table(spark, sf, "orders").selectExpr(*[f"{e} as {c}" for c, e in PAIRS.items()])


# ---------------------------------------------------------------- estimate and rules in SQL

SHARED = """case when floor(least(num_rows_a, num_rows_b) * (row_overlap / 100.0e0)) = 0 and primary_key is not null
  then floor(least(num_rows_a, num_rows_b) * 0.1e0)
  else floor(least(num_rows_a, num_rows_b) * (row_overlap / 100.0e0)) end"""
RATIO = """case strategy
  when 'union' then (null_cells_a + null_cells_b + only_b * num_rows_a + only_a * num_rows_b)::double
    / ((num_rows_a + num_rows_b - ov) * all_columns)
  when 'inner_join' then (null_cells_a::double / (num_rows_a * num_cols_a)
    + null_cells_b::double / (num_rows_b * num_cols_b)) / 2
  when 'left_join' then (null_cells_a + null_cells_b::double / num_rows_b * ov + (num_cols_b - 1) * (num_rows_a - ov))
    / (num_rows_a * (num_cols_a + num_cols_b - has_primary_key))
  when 'right_join' then (null_cells_b + null_cells_a::double / num_rows_a * ov + (num_cols_a - 1) * (num_rows_b - ov))
    / (num_rows_b * (num_cols_a + num_cols_b - has_primary_key))
  when 'outer_join' then (null_cells_a + null_cells_b + (num_cols_a - 1) * (num_rows_b - ov)
    + (num_cols_b - 1) * (num_rows_a - ov)) / ((num_rows_a + num_rows_b - ov) * (num_cols_a + num_cols_b - has_primary_key))
  else (null_cells_a + null_cells_b + abs(num_rows_a - num_rows_b) * case when num_rows_a < num_rows_b then num_cols_a
    else num_cols_b end)::double / (greatest(num_rows_a, num_rows_b) * (num_cols_a + num_cols_b)) end"""
EST = """0.2e0 * greatest(0, 100 * (1 - ratio)) + 0.15e0 * 100 + 0.15e0 * greatest(0, 100 * (1 - ratio * 1.5e0))
  + 0.15e0 * least(100, greatest(diversity_a, diversity_b) + 5) + 0.15e0 * (outlier_score_a + outlier_score_b) / 2
  + 0.1e0 * 95 + 0.1e0 * 95"""
STRATEGY = """case when schema_similarity > 80 then 'union' when primary_key is null then 'concat'
  when row_overlap > 75 then 'inner_join' when row_overlap > 20 then 'left_join' else 'outer_join' end"""


def estimated(source):
    return (f"select *, {EST} as est from (select *, {RATIO} as ratio from (select *, {SHARED} as ov from ({source})))")


RULED = f"""select *, case when apart and q_a >= q_b then 'USE_A' when apart then 'USE_B' else 'FUSE' end as recommendation,
  case when apart then least(95, 60 + abs(q_a - q_b) + (40 - comp_score))
    else least(98, 50 + comp_score * 0.4e0 + greatest(0, gain) * 2) end as confidence
  from (select *, comp_score < 30 and gain < 0 as apart from (select *, round(est - greatest(q_a, q_b), 2) as gain
    from (select * replace (round(est, 2) as est)
      from ({estimated(f"select *, {STRATEGY} as strategy from pairs")}))))"""


@register("e1_estimated_quality", f"""with {PAIRS_SQL} select dataset_a, dataset_b, strategy, round(est, 6) as
    estimated_quality from ({estimated(f'''select * from pairs, (values
      {', '.join(f"('{s}')" for s in recommend.STRATEGIES)}) t(strategy)''')})""")
def e1(spark, sf):
    return rounded(recommend.estimate_all(pairs(spark, sf)).select(
        "dataset_a", "dataset_b", "strategy", "estimated_quality"), 6)


@register("e2_strategy", f"with {PAIRS_SQL} select dataset_a, dataset_b, {STRATEGY} as strategy from pairs")
def e2(spark, sf):
    return pairs(spark, sf).select("dataset_a", "dataset_b", recommend.strategy().alias("strategy"))


@register("e3_fusion_gain", f"""with {PAIRS_SQL} select dataset_a, dataset_b, round(est, 6) as estimated_fused_quality,
    round(est - greatest(q_a, q_b), 6) + 0.0e0 as fusion_gain_score
    from ({estimated(f"select *, {STRATEGY} as strategy from pairs")})""")
def e3(spark, sf):
    found = recommend.with_gain(pairs(spark, sf).withColumn("suggested_strategy", recommend.strategy()), digits=None)
    return rounded(found.select("dataset_a", "dataset_b", "estimated_fused_quality", "fusion_gain_score"), 6)


@register("e4_recommendation", f"""with {PAIRS_SQL} select dataset_a, dataset_b, recommendation, strategy as
    suggested_strategy, est as estimated_fused_quality, gain + 0.0e0 as fusion_gain_score,
    round(confidence, 1) as confidence_score from ({RULED})""")
def e4(spark, sf):
    return recommend.rules(pairs(spark, sf)).select(
        "dataset_a", "dataset_b", "recommendation", "suggested_strategy", "estimated_fused_quality",
        (F.col("fusion_gain_score") + 0.0).alias("fusion_gain_score"), "confidence_score")


def sql_text(template, *parts):
    """A sentence template as a SQL concatenation."""
    pieces = template.replace("%%", "%").replace("%.0f", "%s").split("%s")
    out = [f"'{pieces[0]}'"]
    for piece, part in zip(pieces[1:], parts):
        out += [part, "'" + piece.replace("'", "''") + "'"]
    out[0] = "'" + pieces[0].replace("'", "''") + "'"
    return " || ".join(out)


def txt(c):
    return f"cast(round({c}, 2) as varchar)"


T = recommend.RULE_TEXT
REASONS = f"""concat_ws(' ~ ',
  case recommendation when 'USE_A' then {sql_text(T['use_a'], txt('q_a'), txt('q_b'))} || ' ~ ' || {sql_text(T['use_a_why'])}
    when 'USE_B' then {sql_text(T['use_b'], txt('q_b'), txt('q_a'))} || ' ~ ' || {sql_text(T['use_b_why'])}
    else concat_ws(' ~ ', {sql_text(T['fuse'], 'upper(strategy)')},
      case when strategy = 'union' then {sql_text(T['union'], txt('schema_similarity'))} || ' ~ '
        || {sql_text(T['union_rows'], 'num_rows_a', 'num_rows_b',
                     "cast(num_rows_a + num_rows_b - floor(least(num_rows_a, num_rows_b) * (row_overlap / 100.0e0)) as bigint)")}
      when primary_key is not null then {sql_text(T['key'], 'primary_key')} || ' ~ '
        || {sql_text(T['key_columns'], 'num_cols_a',
                     "cast(cast(round(num_cols_a + unique_feature_gain / 100.0e0 * num_cols_a) as bigint) as varchar)")}
      else {sql_text(T['concat'])} end,
      case when gain > 0 then {sql_text(T['gain'], 'cast(gain as varchar)')}
        else {sql_text(T['loss'], 'cast(gain as varchar)')} end) end,
  {sql_text(T['quality'], txt('q_a'), txt('q_b'))}, {sql_text(T['score'], txt('comp_score'))})"""


@register("e5_reasons", f"with {PAIRS_SQL} select dataset_a, dataset_b, {REASONS} as reasoning from ({RULED})")
def e5(spark, sf):
    return recommend.rules(pairs(spark, sf)).select(
        "dataset_a", "dataset_b", F.array_join("reasoning", " ~ ").alias("reasoning"))


# ---------------------------------------------------------------- the second score

AVERAGES = {
    "o_orderkey": "o_orderkey", "avg_quality": "(o_orderkey * 7 % 1001) / 10.0e0",
    "avg_overlap": "(o_orderkey * 11 % 1001) / 10.0e0", "avg_complementarity": "(o_custkey * 13 % 1001) / 10.0e0",
    "avg_improvement": "(o_orderkey * 17 % 801) / 10.0e0 - 40",
}
AVERAGES_SQL = f"avgs as (select {', '.join(f'{e} as {c}' for c, e in AVERAGES.items())} from orders)"
OVERALL = """greatest(0, least(100, avg_quality * 0.25e0 + (100 - abs(50 - avg_overlap)) * 0.15e0
  + avg_complementarity * 0.3e0 + greatest(0, least(100, 50 + avg_improvement)) * 0.3e0))"""


def averages(spark, sf):
    return table(spark, sf, "orders").selectExpr(*[f"{e} as {c}" for c, e in AVERAGES.items()])


@register("e6_overall_score", f"""with {AVERAGES_SQL} select o_orderkey, round({OVERALL}, 4) as overall_score,
    {OVERALL} >= 65 as recommended from avgs""")
def e6(spark, sf):
    return rounded(recommend.overall_v2(averages(spark, sf)).select("o_orderkey", "overall_score", "recommended"))


def pct(template, c):
    return f"printf('{template}', {c})"


V = recommend.OVERALL_TEXT


@register("e7_overall_reasons", f"""with {AVERAGES_SQL} select o_orderkey, concat_ws(' ~ ',
    case when avg_quality > 70 then {pct(V['quality_good'], 'avg_quality')} else {pct(V['quality_bad'], 'avg_quality')} end,
    case when avg_overlap between 30 and 70 then {pct(V['overlap_good'], 'avg_overlap')} when avg_overlap > 70
      then {pct(V['overlap_high'], 'avg_overlap')} else {pct(V['overlap_low'], 'avg_overlap')} end,
    case when avg_complementarity > 50 then {pct(V['complementarity_good'], 'avg_complementarity')}
      else {pct(V['complementarity_bad'], 'avg_complementarity')} end,
    case when avg_improvement > 10 then {pct(V['improvement_good'], 'avg_improvement')} when avg_improvement > 0
      then {pct(V['improvement_some'], 'avg_improvement')} else {pct(V['improvement_none'], 'avg_improvement')} end,
    case when {OVERALL} >= 65 then '{V['yes']}' else '{V['no']}' end) as reasons from avgs""")
def e7(spark, sf):
    return recommend.overall_v2(averages(spark, sf)).select("o_orderkey", F.array_join("reasons", " ~ ").alias("reasons"))


@register("e6_study_fusion")
def e6_study(spark, sf):
    ev, orders = view(spark, sf, "ev_null"), view(spark, sf, "ord_null")
    found = plans.study_fusion({"events": ev, "orders": orders}, {"events": ["event_id"], "orders": ["event_id"]},
                               target="value")
    return found["overall"].select("avg_quality", "avg_overlap", "avg_complementarity", "overall_score", "recommended")


# ---------------------------------------------------------------- features, samples, models

SPARSE_PAIRS = ["q_a", "row_overlap", "dup_score_b", "num_rows_a", "num_cols_b"]
DEFAULTS = {**{f: 0.0 for f in recommend.FEATURES}, **recommend.FEATURE_DEFAULTS}


@register("m1_features", f"""with {PAIRS_SQL} select dataset_b, {', '.join(
    f"coalesce(case when num_rows_b % 5 > 0 then cast({f} as double) end, {DEFAULTS[f]}e0) as {f}" if f in SPARSE_PAIRS
    else f"cast({f} as double) as {f}" for f in recommend.FEATURES)} from pairs""")
def m1(spark, sf):
    gaps = pairs(spark, sf).withColumns({c: F.when(F.col("num_rows_b") % 5 > 0, F.col(c)) for c in SPARSE_PAIRS})
    return recommend.features(gaps).select("dataset_b", *recommend.FEATURES)


NATIONS = """select concat('n', c_nationkey) as dataset, count(*) as n_rows, 3 + c_nationkey % 5 as n_cols,
    cast(count(*) filter (where c_acctbal < 0) as bigint) as null_cells, round(avg(c_acctbal) / 100, 4) as quality_score,
    count(distinct c_mktsegment) * 20.0e0 as missing_values, 99.5e0 as duplicate_rows, 75.0e0 as data_completeness,
    round(max(c_acctbal) / 100, 4) as feature_diversity, 98.0e0 as outlier_ratio, 100.0e0 as data_consistency,
    100.0e0 as data_type_validity, count(*) as duplicate_count, concat(c_nationkey, ' KB') as size_text
    from customer group by c_nationkey"""


def nations(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("blendscope_customer")
    return spark.sql(NATIONS.replace("from customer", "from blendscope_customer")).withColumn(
        "columns", F.slice(F.array(*[F.lit(x) for x in "abcdefg"]), F.col("n_cols") - 2, 3))


def nation_pairs(spark, sf):
    placed = rowindex.dense_index(nations(spark, sf).select("dataset"), ["dataset"], "ordinal")
    return compat.pairs(placed)


NATION_PAIRS = "a join n b on a.dataset < b.dataset"


@register("j10_pair_features", f"""with n as (select *, list_slice(['a', 'b', 'c', 'd', 'e', 'f', 'g'], n_cols - 2,
    n_cols) as columns from ({NATIONS})) select a.dataset as dataset_a, b.dataset as dataset_b, a.n_rows as num_rows_a,
    b.n_rows as num_rows_b, round(a.quality_score, 2) as q_a, round(b.quality_score, 2) as q_b,
    a.null_cells as null_cells_a, cast(len(a.columns) - len(list_intersect(a.columns, b.columns)) as integer) as only_a,
    cast(len(b.columns) - len(list_intersect(a.columns, b.columns)) as integer) as only_b,
    cast(len(list_distinct(list_concat(a.columns, b.columns))) as integer) as all_columns, 1.0e0 as has_primary_key,
    abs(a.n_rows - b.n_rows) * 1.0e0 as row_overlap from n {NATION_PAIRS}""")
def j10(spark, sf):
    profiles = nations(spark, sf)
    sizes = profiles.select("dataset", "n_rows")
    compared = nation_pairs(spark, sf).join(sizes.toDF("dataset_a", "x"), "dataset_a").join(
        sizes.toDF("dataset_b", "y"), "dataset_b").withColumn("row_overlap", F.abs(F.col("x") - F.col("y")) * 1.0)
    compared = compared.withColumns({c: F.lit(50.0) for c in (
        "schema_similarity", "column_name_similarity", "dtype_compatibility", "common_columns_ratio",
        "unique_feature_gain", "correlation_similarity", "missing_value_overlap", "compatibility_score")}).withColumns(
        {"primary_key": F.lit("id"), "key_info": F.lit("")})
    return recommend.pair_features(profiles, compared).select(
        "dataset_a", "dataset_b", "num_rows_a", "num_rows_b", "q_a", "q_b", "null_cells_a", "only_a", "only_b",
        "all_columns", "has_primary_key", "row_overlap")


DIGEST = "md5(concat_ws('|', cast(o_orderkey as varchar), cast(o_orderstatus as varchar), '42'))"


@register("r6_stable_sample", f"select o_orderkey, o_orderstatus, o_totalprice from orders order by {DIGEST} limit 1000")
def r6(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ml.stable_sample(orders, 1000, key=["o_orderkey", "o_orderstatus"])


@register("r8_train_test_split", f"""select o_orderkey, case when cast('0x' || substr({DIGEST}, 1, 8) as bigint) % 10000
    < 8000 then 'train' else 'test' end as part from orders""")
def r8(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    train, test = ml.split(orders, key=["o_orderkey", "o_orderstatus"])
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        test.select("o_orderkey", F.lit("test").alias("part")))


COPIES = """(select *, md5(concat_ws('|', l_returnflag, l_linestatus, cast(l_linenumber as varchar), '42')) as digest,
    row_number() over (partition by l_returnflag, l_linestatus, l_linenumber order by 1) as copy from li_dup)"""
COPY_DIGEST = "case when copy = 1 then digest else md5(digest || '|' || cast(copy as varchar)) end"


@register("r6_stable_sample_repeats", with_views("li_dup", f"""select l_returnflag, l_linestatus, l_linenumber, count(*) as n
    from (select * from {COPIES} order by {COPY_DIGEST} limit 1000) group by all"""))
def r6_repeats(spark, sf):
    return ml.stable_sample(view(spark, sf, "li_dup"), 1000).groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.count("*").alias("n"))


@register("r8_split_repeats", with_views("li_dup", f"""select l_returnflag, l_linestatus, l_linenumber, count(*) filter (
    cast('0x' || substr({COPY_DIGEST}, 1, 8) as bigint) % 10000 < 8000) as n_train, count(*) filter (
    cast('0x' || substr({COPY_DIGEST}, 1, 8) as bigint) % 10000 >= 8000) as n_test from {COPIES} group by all"""))
def r8_repeats(spark, sf):
    train, test = ml.split(view(spark, sf, "li_dup"))
    both = train.withColumn("part", F.lit(1)).unionByName(test.withColumn("part", F.lit(0)))
    return both.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.count_if(F.col("part") == 1).alias("n_train"), F.count_if(F.col("part") == 0).alias("n_test"))


@register("m3_train_recommender")
def m3(spark, sf):
    data = pairs(spark, sf)
    train, test = ml.split(data, key=["dataset_b"])
    models = ml.train_recommender(train)
    judged = recommend.rules(test).select("dataset_b", F.col("recommendation").alias("label"))
    guessed = ml.predict(models, test).select("dataset_b", F.col("recommendation").alias("guess"))
    return rounded(ml.evaluate(judged.join(guessed, "dataset_b"), "label", "guess"))


@register("m6_model_recommend")
def m6(spark, sf):
    data = pairs(spark, sf)
    models = ml.train_recommender(data)
    return ml.recommend(models, data).select(
        "dataset_a", "dataset_b", "recommendation", "suggested_strategy", "confidence_score", "fusion_gain_score",
        F.array_join("reasoning", " ~ ").alias("reasoning"))


PREDICTED = """(select o_orderpriority as label, case o_orderkey % 3 when 0 then '1-URGENT' when 1 then o_orderpriority
    else '2-HIGH' end as prediction from orders)"""


@register("m4_confusion", f"select label, prediction, count(*) as n from {PREDICTED} group by label, prediction")
def m4_confusion(spark, sf):
    return ml.confusion(predictions(spark, sf), "label", "prediction")


@register("m4_evaluate", f"""with p as {PREDICTED}, c as (select distinct label as class from p union
    select distinct prediction from p), m as (select class,
      (select count(*) from p where label = class) as actual, (select count(*) from p where prediction = class) as guessed,
      (select count(*) from p where label = class and prediction = class) as hit from c),
    s as (select *, case when guessed = 0 then 0 else hit / guessed::double end as pr,
      case when actual = 0 then 0 else hit / actual::double end as rc from m)
    select round(sum(hit) / sum(actual)::double, 4) as accuracy, round(sum(pr * actual) / sum(actual), 4) as precision,
      round(sum(rc * actual) / sum(actual), 4) as recall, round(sum(case when pr + rc = 0 then 0 else
      2 * pr * rc / (pr + rc) end * actual) / sum(actual), 4) as f1, cast(sum(actual) as bigint) as n from s""")
def m4(spark, sf):
    return rounded(ml.evaluate(predictions(spark, sf), "label", "prediction"))


def predictions(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderpriority as label", "case o_orderkey % 3 when 0 then '1-URGENT' when 1 then o_orderpriority "
        "else '2-HIGH' end as prediction")


IMPORTANCE = {f: 1.0 / (i + 2) for i, f in enumerate(recommend.FEATURES)}


def contribution(i, f):
    bound = "100.0e0" if any(k in f for k in ("score", "ratio", "similarity")) else "10000.0e0"
    return f"select dataset_b, '{f}' as name, {i} as i, cast({f} as double) / {bound} * {IMPORTANCE[f]!r}::double as w from pairs"


@register("m7_top_features", f"""with {PAIRS_SQL} select dataset_b, string_agg(name, ',' order by w desc, i) as
    top_features from (select *, row_number() over (partition by dataset_b order by w desc, i) as rn from
    ({union_all([contribution(i, f) for i, f in enumerate(recommend.FEATURES)])})) where rn <= 3 group by dataset_b""")
def m7(spark, sf):
    return ml.top_features(pairs(spark, sf), IMPORTANCE).select(
        "dataset_b", F.array_join("top_features", ",").alias("top_features"))


@register("m8_fusion_lift")
def m8(spark, sf):
    a, b = view(spark, sf, "ev_null"), view(spark, sf, "ord_null")
    return rounded(ml.fusion_lift(a, b, target="value"))


@register("m9_improvement", """select o_orderkey, round(((o_orderkey % 1000) / 1000.0e0 - ((o_custkey % 997) / 1000.0e0
    - 0.2e0)) / (abs((o_custkey % 997) / 1000.0e0 - 0.2e0) + 0.001e0) * 100, 4) + 0.0e0 as improvement from orders""")
def m9(spark, sf):
    scores = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "(o_orderkey % 1000) / 1000.0e0 as fused", "(o_custkey % 997) / 1000.0e0 - 0.2e0 as single")
    return rounded(scores.select("o_orderkey", ml.improvement(F.col("fused"), F.col("single")).alias("improvement")))


# ---------------------------------------------------------------- reports

OVERVIEW_ROWS = [("Number of Rows", "cast({s}.n_rows as varchar)"), ("Number of Columns", "cast({s}.n_cols as varchar)"),
                 ("File Size", "{s}.size_text"), ("Duplicate Rows", "cast({s}.duplicate_count as varchar)"),
                 ("Quality Score", "cast(round({s}.quality_score, 2) as varchar) || '/100'")]


@register("b1_overview", f"with n as ({NATIONS}) " + union_all([
    f"select a.dataset as dataset_a, b.dataset as dataset_b, '{m}' as metric, {e.format(s='a')} as value_a, "
    f"{e.format(s='b')} as value_b from n {NATION_PAIRS}" for m, e in OVERVIEW_ROWS]))
def b1(spark, sf):
    return report.overview(nations(spark, sf), nation_pairs(spark, sf))


@register("b2_quality_breakdown", f"with n as ({NATIONS}) " + union_all([
    f"select a.dataset as dataset_a, b.dataset as dataset_b, '{c.replace('_', ' ').title()}' as metric, "
    f"'{round(w * 100)}%' as weight, cast(round(a.{c}, 2) as varchar) || '/100' as value_a, "
    f"cast(round(b.{c}, 2) as varchar) || '/100' as value_b from n {NATION_PAIRS}" for c, w in QUALITY_WEIGHTS.items()]))
def b2(spark, sf):
    return report.quality(nations(spark, sf), nation_pairs(spark, sf))


def compat_line(name, label, detail):
    shown = f"'{detail}'" if detail else "concat('Matched ', coalesce(primary_key, 'nothing'))"
    return (f"select dataset_a, dataset_b, '{label}' as attribute, cast(round({name}, 2) as varchar) || '%' as score, "
            f"{shown} as detail from pairs")


@register("b3_compatibility", f"with {PAIRS_SQL} " + union_all([
    compat_line(n, label, d) for n, (label, d) in report.COMPATIBILITY.items()]))
def b3(spark, sf):
    return report.compat(pairs(spark, sf).withColumn(
        "key_info", F.concat(F.lit("Matched "), F.coalesce("primary_key", F.lit("nothing")))))


FUSED = """select o_orderkey, case o_orderkey % 2 when 0 then 'union' else 'left_join' end as strategy,
    case o_orderkey % 2 when 1 then 'id' end as primary_key, o_orderkey as rows_before_a, o_custkey as rows_before_b,
    o_orderkey + o_custkey - o_orderkey % 3 as rows_after, 5 as cols_before_a, cast(3 + o_orderkey % 4 as int) as cols_before_b,
    cast(7 + o_orderkey % 4 as int) as cols_after, o_custkey % 13 as duplicate_rows, o_custkey % 101 as missing_cells,
    (o_custkey % 101) / 4.0e0 as missing_ratio from orders"""
FUSION_ROWS = [
    ("Applied Strategy", "upper(strategy)", "'Primary key: ' || coalesce(primary_key, 'None (Concat/Union)')"),
    ("Initial Rows", "concat('A: ', rows_before_a, ' | B: ', rows_before_b)",
     "concat('Total raw: ', rows_before_a + rows_before_b)"),
    ("Resulting Rows", "concat('', rows_after)", "concat('Delta: ', rows_after - greatest(rows_before_a, rows_before_b))"),
    ("Initial Columns", "concat('A: ', cols_before_a, ' | B: ', cols_before_b)", "''"),
    ("Resulting Columns", "concat('', cols_after)", "concat('Delta: ', cols_after - greatest(cols_before_a, cols_before_b))"),
    ("Duplicates Cleaned", "concat('', duplicate_rows)", "'Exact row duplicates removed during fusion'"),
    ("Missing Cells Ratio", "concat(missing_cells, ' (', round(missing_ratio, 2), '%)')", "'Null values in merged structure'"),
]


@register("b4_fusion_report", f"with f as ({FUSED}) " + union_all([
    f"select o_orderkey, '{a}' as attribute, {v} as value, {n} as notes from f" for a, v, n in FUSION_ROWS]))
def b4(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("blendscope_orders")
    stats = spark.sql(FUSED.replace("from orders", "from blendscope_orders"))
    return report.fusion(stats, ["o_orderkey"])


@register("b5_action_text", f"""with {PAIRS_SQL} select dataset_a, dataset_b, case recommendation when 'FUSE'
    then 'FUSE DATASETS' else 'USE ' || right(recommendation, 1) end as action_text,
    case when q_a >= 70 then 'good' else 'fair' end as quality_band_a,
    case when q_b >= 70 then 'good' else 'fair' end as quality_band_b from ({RULED})""")
def b5(spark, sf):
    return report.action(recommend.rules(pairs(spark, sf))).select(
        "dataset_a", "dataset_b", "action_text", "quality_band_a", "quality_band_b")
