"""Combining tables: union, positional concatenation, joins, N-way fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import INTEGRAL, col, dtype_of, is_numeric, is_string
from ..session import agg_row, local_table, materialize, together
from ..sources.io import normalize
from .clean import drop_empty_columns, impute
from .profile import duplicate_rows
from .rowindex import indexed
from .schema import align, drop_duplicate_names, separate_cases, suffix_clashes, to_common_types, with_source
from .types import clean_numeric_names

JOINS = {"inner_join": "inner", "left_join": "left", "right_join": "right", "outer_join": "outer"}
STRATEGIES = ["union", "concat", *JOINS]


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both over all columns, sorted by name, without exact duplicates."""
    wide_a, wide_b = align(*to_common_types(normalize(a), normalize(b)))
    return wide_a.unionByName(wide_b).distinct()


def concat(a: DataFrame, b: DataFrame, order_a, order_b) -> DataFrame:
    """Row i of A beside row i of B; the shorter side is padded with NULLs. No de-duplication."""
    b_named = suffix_clashes(a, normalize(b))
    order_b = [b_named.columns[b.columns.index(k)] for k in order_b]
    (left, _), (right, _) = together(
        a.sparkSession, lambda: indexed(normalize(a), order_a, "_row"), lambda: indexed(b_named, order_b, "_row_b"))
    both = left.join(right, F.col("_row") == F.col("_row_b"), "full_outer")
    return both.select(*[col(c) for c in a.columns], *[col(c) for c in b_named.columns])


def comparable_keys(a: DataFrame, b: DataFrame, keys) -> tuple:
    """Bring each key to one type on both sides; numbers never match text."""
    for k in keys:
        ta, tb = dtype_of(a, k), dtype_of(b, k)
        if ta == tb or (is_string(ta) and is_string(tb)):
            continue
        if not (is_numeric(ta) and is_numeric(tb)):
            raise ValueError(f"key {k!r} is {ta.simpleString()} on one side and {tb.simpleString()} on the other")
        shared = "bigint" if isinstance(ta, INTEGRAL) and isinstance(tb, INTEGRAL) else "double"
        a, b = (df.withColumn(k, col(k).cast(shared)) for df in (a, b))
    return a, b


def join(a: DataFrame, b: DataFrame, key, how: str = "inner", distinct: bool = True) -> DataFrame:
    """Equi-join on one or more keys where NULL keys match each other; the key appears once.

    With ``distinct`` each side loses its duplicates before the join. That gives the same rows as
    removing duplicates afterwards, for far fewer shuffled rows when keys repeat.

    Outer variants are an inner join plus the unmatched rows of each side. An inner join is the one
    kind that adaptive execution can split on both sides when one key holds much of a table; the
    unmatched rows are found against distinct keys, which no key dominates.
    """
    keys = [key] if isinstance(key, str) else list(key)
    for k in keys:
        if k not in a.columns or k not in b.columns:
            raise ValueError(f"key {k!r} is not a column of both tables")
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join type: {how}")
    a, b = comparable_keys(normalize(a), normalize(b), keys)
    b = suffix_clashes(a, b, keep=keys)
    inner_key = {k: f"_key{i}" for i, k in enumerate(keys)}
    b = b.select(*[col(c).alias(inner_key.get(c, c)) for c in b.columns])
    new = [c for c in b.columns if c not in inner_key.values()]
    keys_a = a.select(*[col(k) for k in keys]).distinct()
    keys_b = b.select(*inner_key.values()).distinct()
    if distinct:
        a, b = a.distinct(), b.distinct()
    match = reduce(lambda x, y: x & y, [col(k).eqNullSafe(F.col(r)) for k, r in inner_key.items()])
    columns = [*a.columns, *new]

    def null(df, c):
        return F.lit(None).cast(dtype_of(df, c)).alias(c)

    out = a.join(b, match, "inner").select(*[col(c) for c in columns])
    if how in ("left", "outer"):
        lone = a.join(keys_b, match, "left_anti")
        out = out.unionByName(lone.select(*[col(c) for c in a.columns], *[null(b, c) for c in new]))
    if how in ("right", "outer"):
        lone = b.join(keys_a, match, "left_anti")
        out = out.unionByName(lone.select(*[
            F.col(inner_key[c]).alias(c) if c in inner_key else null(a, c) for c in a.columns
        ], *[col(c) for c in new]))
    return out


ESTIMATE = "join_type string, n_rows decimal(38,0), null_cells decimal(38,0), largest_key string, largest_key_rows decimal(38,0)"


def estimate(a: DataFrame, b: DataFrame, key, how: str = "inner", distinct: bool = True) -> DataFrame:
    """One row: how many rows and NULL cells ``join`` would give, and the key with the most rows, without joining.

    Both sides shrink to a histogram of keys (rows and NULL cells per key); rows multiply key by key, so the cost does not depend on
    the size of the result. The numbers are exact.
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join type: {how}")
    keys = [key] if isinstance(key, str) else list(key)
    a, b = comparable_keys(normalize(a), normalize(b), keys)
    widths = {s: len(df.columns) - len(keys) for s, df in (("a", a), ("b", b))}

    def histogram(df, side):
        df = df.distinct() if distinct else df
        empty = sum((col(c).isNull().cast("bigint") for c in df.columns if c not in keys), F.lit(0).cast("bigint"))
        return df.groupBy(*[col(k).alias(f"_{side}{i}") for i, k in enumerate(keys)]).agg(
            F.count("*").cast("decimal(18,0)").alias(f"n_{side}"), F.sum(empty).cast("decimal(18,0)").alias(f"z_{side}"))

    match = reduce(lambda x, y: x & y, [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))])
    both = histogram(a, "a").join(histogram(b, "b"), match, "full_outer")
    none = sum((F.coalesce(F.col(f"_a{i}"), F.col(f"_b{i}")).isNull().cast("int") for i in range(len(keys))), F.lit(0))
    n_a, n_b, z_a, z_b = (F.col(c) for c in ("n_a", "n_b", "z_a", "z_b"))
    keep_a, keep_b = how in ("left", "outer"), how in ("right", "outer")
    n = F.when(n_a.isNull(), n_b if keep_b else F.lit(0)).when(n_b.isNull(), n_a if keep_a else F.lit(0)).otherwise(n_a * n_b)
    gaps = F.when(n_a.isNull(), z_b + n_b * widths["a"] if keep_b else F.lit(0)).when(
        n_b.isNull(), z_a + n_a * widths["b"] if keep_a else F.lit(0)).otherwise(z_a * n_b + z_b * n_a)
    whole = "decimal(38,0)"
    per_key = both.select(n.cast(whole).alias("n"), gaps.cast(whole).alias("gaps"), none.alias("none"), F.concat_ws(
        "|", *[F.coalesce(F.col(f"_a{i}"), F.col(f"_b{i}")).cast("string") for i in range(len(keys))]).alias("key"))
    top = F.max(F.struct("n", "key"))
    return per_key.where("n > 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast(whole).alias("n_rows"),
        F.coalesce(F.sum(F.col("gaps") + F.col("n") * F.col("none")), F.lit(0)).cast(whole).alias("null_cells"),
        top["key"].alias("largest_key"), F.coalesce(top["n"], F.lit(0)).cast(whole).alias("largest_key_rows"),
    ).select(F.lit(how).alias("join_type"), "*")


def union_all_named(tables: dict) -> DataFrame:
    """All rows over all columns plus the name of the table each row came from."""
    parts = [with_source(normalize(df), name) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out, part = to_common_types(out, part)
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _numbers_where_clean(tables: dict, common: list) -> dict:
    """Cast common text columns to double where every table allows it, to text where types differ."""
    tables = {n: normalize(df) for n, df in tables.items()}
    ok = {n: set(clean_numeric_names(df, common)) for n, df in tables.items()}
    kinds = {}
    for c in common:
        numeric = all(is_numeric(dtype_of(df, c)) or c in ok[n] for n, df in tables.items())
        types = {dtype_of(df, c).simpleString() for df in tables.values()}
        kinds[c] = None if len(types) == 1 and not (numeric and types == {"string"}) else (
            "double" if numeric else "string")
    return {n: df.select(*[col(c).cast(kinds[c]).alias(c) if kinds.get(c) else col(c) for c in df.columns])
            for n, df in tables.items()}


def merge_many(tables: dict, mode: str = "per_dataset", append_rows: bool = False) -> DataFrame:
    """The raw N-way fusion, before filling.

    Without a common column: union of everything with a source column. Else full outer joins on all
    common columns, NULLs equal: one join per table (``per_dataset``) or one per new column
    (``per_column``, in which repeated keys multiply once for every new column). A table without a new
    column adds nothing unless ``append_rows``.
    """
    names = list(tables)
    if len(names) < 2:
        raise ValueError("need at least 2 datasets to fuse")
    if mode not in ("per_dataset", "per_column"):
        raise ValueError(f"unknown mode: {mode}")
    tables = dict(zip(names, separate_cases(*tables.values())))
    others = [set(tables[n].columns) for n in names[1:]]
    common = [c for c in tables[names[0]].columns if all(c in o for o in others)]
    if not common:
        return union_all_named(tables)
    tables = _numbers_where_clean(tables, common)
    out, joined = tables[names[0]], False
    for name in names[1:]:
        df = tables[name]
        new = [c for c in df.columns if c not in out.columns]
        if not new:
            if append_rows:
                out = out.unionByName(df.select(*[col(c) for c in df.columns if c in out.columns]),
                                      allowMissingColumns=True)
            continue
        for group in ([new] if mode == "per_dataset" else [[c] for c in new]):
            side = df.select(*[col(c) for c in (*common, *group)])
            out = join(materialize(out, "merge-step") if joined else out, side, common, "outer", distinct=False)
            joined = True
    return drop_duplicate_names(out)


def fuse_many(tables: dict, mode: str = "per_dataset", append_rows: bool = False) -> tuple:
    """N-way fusion with empty columns dropped and gaps filled: (table, one row of metadata)."""
    merged = materialize(merge_many(tables, mode, append_rows), "merged")
    return finish_many(merged, list(tables))


def finish_many(merged: DataFrame, names: list) -> tuple:
    """Drop empty columns, fill numbers by median and the rest by ``Unknown``, describe the outcome."""
    filled = impute(drop_empty_columns(merged), "median", "unknown")
    meta = filled.agg(F.count("*").alias("total_rows")).select(
        F.array(*[F.lit(n) for n in names]).alias("original_datasets"), "total_rows",
        F.lit(len(filled.columns)).alias("total_columns"),
        F.array(*[F.lit(c) for c in filled.columns]).alias("columns"),
        F.current_timestamp().alias("fused_at"),
    )
    return filled, meta


def stats(a: DataFrame, b: DataFrame, fused: DataFrame, strategy: str, key: str = None) -> DataFrame:
    """One row: sizes before and after, missing cells and their percentage, duplicates left."""
    fused = normalize(fused)
    seen, copies, rows_a, rows_b = together(
        fused.sparkSession,
        lambda: agg_row(fused, {"*": F.count(F.lit(1)), **{(c,): F.count(col(c)) for c in fused.columns}}),
        lambda: duplicate_rows(fused).first()["duplicate_rows"], a.count, b.count)
    n, width = seen["*"], len(fused.columns)
    missing = sum(n - seen[c,] for c in fused.columns)
    cells = n * width
    row = (strategy, key, rows_a, rows_b, len(a.columns), len(b.columns), n, width, missing,
           100.0 * missing / cells if cells else 0.0, copies)
    return local_table(fused.sparkSession, [row], FUSION_STATS)


FUSION_STATS = (
    "strategy string, primary_key string, rows_before_a bigint, rows_before_b bigint, cols_before_a int, "
    "cols_before_b int, rows_after bigint, cols_after int, missing_cells bigint, missing_ratio double, "
    "duplicate_rows bigint"
)
