"""Comparing two tables, and the pairs of a catalog."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import INTEGRAL, as_double, col, dtype_of, is_numeric, numeric_names
from ..functions.names import best_of, best_ratios, clean_name
from ..session import agg_row, local_table, together
from ..sources.io import normalize
from .profile import correlation_dict, cross_correlation, distinct_counts
from .rowindex import indexed, tie_digest
from .schema import clean_names, common_columns, only_in_first, same_kind

# Names that mark a key, in order of preference.
KEY_NAMES = ["id", "uuid", "code", "date", "index", "key", "pk"]

# Share of each similarity in the compatibility score.
COMPATIBILITY_WEIGHTS = {
    "schema_similarity": 0.25,
    "dtype_compatibility": 0.15,
    "common_columns_ratio": 0.15,
    "column_name_similarity": 0.15,
    "row_overlap": 0.15,
    "correlation_similarity": 0.15,
}

NO_KEY = "No common identifier column found."  # fixed value


# ---------------------------------------------------------------- keys

def key_by_name(names: list):
    """The first of ``names`` that looks like a key, or None."""
    for mark in KEY_NAMES:
        if mark in names:
            return mark
        for name in names:
            if name.startswith(mark + "_") or name.endswith("_" + mark):
                return name
    return None


def find_key(a: DataFrame, b: DataFrame):
    """A common column to join on: by name, else the first one without NULLs or repeats on both sides.

    Uniqueness costs an exact distinct count, so a sketch first rules out columns far from unique.
    """
    common = common_columns(a, b)
    named = key_by_name(common)
    if named or not common:
        return named
    alive = common
    for df in (normalize(a), normalize(b)):
        if not alive:
            return None
        seen = agg_row(df, {"*": F.count(F.lit(1)), **{(c, "n"): F.count(col(c)) for c in alive},
                            **{(c, "d"): F.approx_count_distinct(col(c)) for c in alive}})
        n = seen["*"]
        likely = [c for c in alive if seen[c, "n"] == n and seen[c, "d"] >= 0.5 * n]
        exact = distinct_counts(df, likely)
        alive = [c for c in likely if exact[c] == n]
    return alive[0] if alive else None


# ---------------------------------------------------------------- values

def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct non-NULL key values of A, of B, of both, of either. One shuffle of keys."""
    a, b = normalize(a.select(col(key))), normalize(b.select(col(key)))
    if same_kind(a, b, key):
        def mark(df, in_a, in_b):
            kind = "double" if is_numeric(dtype_of(df, key)) and not both_whole else None
            value = col(key).cast(kind) if kind else (
                col(key).cast("bigint") if is_numeric(dtype_of(df, key)) else col(key).cast("string"))
            return df.select(value.alias("v"), F.lit(in_a).alias("in_a"), F.lit(in_b).alias("in_b"))

        both_whole = all(isinstance(dtype_of(df, key), INTEGRAL) for df in (a, b))
        tagged = mark(a, 1, 0).unionByName(mark(b, 0, 1))
    else:  # a number never equals a text
        def text(df, in_a, in_b):
            return df.select(F.concat(F.lit("a" if in_a else "b"), col(key).cast("string")).alias("v"),
                             F.lit(in_a).alias("in_a"), F.lit(in_b).alias("in_b"))

        tagged = text(a, 1, 0).unionByName(text(b, 0, 1))
    per_value = tagged.where("v is not null").groupBy("v").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return per_value.agg(
        F.coalesce(F.sum("in_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("in_b"), F.lit(0)).alias("n_b"),
        F.coalesce(F.sum(F.col("in_a") * F.col("in_b")), F.lit(0)).alias("n_both"), F.count("*").alias("n_either"),
    )


def value_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per common numeric column: distinct values of A, of B, of both. One shuffle for all columns."""
    shared = [c for c in common_columns(a, b) if is_numeric(dtype_of(a, c)) and is_numeric(dtype_of(b, c))]
    schema = "column string, n_a bigint, n_b bigint, n_both bigint"
    if not shared:
        return local_table(a.sparkSession, [], schema)
    a, b = normalize(a.select(*[col(c) for c in shared])), normalize(b.select(*[col(c) for c in shared]))
    whole = [all(isinstance(dtype_of(df, c), INTEGRAL) for df in (a, b)) for c in shared]

    def cells(df, in_a, in_b):
        parts = []
        for i, (c, w) in enumerate(zip(shared, whole)):
            parts += [F.lit(i), col(c).cast("bigint") if w else F.lit(None).cast("bigint"),
                      F.lit(None).cast("double") if w else as_double(c)]
        return df.select(F.stack(F.lit(len(shared)), *parts).alias("ordinal", "whole", "real")).where(
            "whole is not null or real is not null").select(
            "*", F.lit(in_a).alias("in_a"), F.lit(in_b).alias("in_b"))

    per_value = cells(a, 1, 0).unionByName(cells(b, 0, 1)).groupBy("ordinal", "whole", "real").agg(
        F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    counts = per_value.groupBy("ordinal").agg(
        F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"), F.sum(F.col("in_a") * F.col("in_b")).alias("n_both"))
    names = local_table(a.sparkSession, list(enumerate(shared)), "ordinal int, column string")
    return F.broadcast(names).join(counts, "ordinal", "left").select(
        "column", *[F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in ("n_a", "n_b", "n_both")])


WORD_BITS = 62  # tables per bitmap word


def value_families(tables: dict, wanted: dict) -> dict:
    """``{(table, column): [family, ...]}``: how values of a column are compared.

    Whole numbers among themselves exactly (``whole``), with fractions as doubles (``real``), texts as ``text``.
    """
    fractions = {c for n, cols in wanted.items() for c in cols
                 if is_numeric(dtype_of(tables[n], c)) and not isinstance(dtype_of(tables[n], c), INTEGRAL)}
    out = {}
    for n, cols in wanted.items():
        for c in cols:
            kind = dtype_of(tables[n], c)
            if isinstance(kind, INTEGRAL):
                out[n, c] = ["whole", "real"] if c in fractions else ["whole"]
            else:
                out[n, c] = ["real"] if is_numeric(kind) else ["text"]
    return out


def value_index(tables: dict, wanted: dict) -> DataFrame:
    """Rows (column, family, members, n): n distinct non-NULL values of a column occur in exactly the tables ``members``.

    ``wanted`` names the columns of each table. An inverted index from values to bitmaps of tables, in one shuffle whatever the
    number of tables and pairs: a value moves once per task and table that holds it, and bitmaps merge on the way.
    """
    names = list(tables)
    families = value_families(tables, wanted)
    columns = sorted({c for cols in wanted.values() for c in cols})
    words = [f"_w{k}" for k in range(-(-len(names) // WORD_BITS))]
    kinds = {"whole": "bigint", "real": "double", "text": "string"}
    parts = []
    for i, n in enumerate(names):
        cells = []
        for c in wanted.get(n, []):
            for family in families[n, c]:
                cells += [F.lit(columns.index(c)), *[
                    col(c).cast(kind) if f == family else F.lit(None).cast(kind) for f, kind in kinds.items()]]
        if cells:
            df = normalize(tables[n].select(*[col(c) for c in wanted[n]]))
            flags = [F.lit(1 << (i % WORD_BITS) if k == i // WORD_BITS else 0).cast("bigint").alias(w) for k, w in enumerate(words)]
            found = df.select(F.stack(F.lit(len(cells) // 4), *cells).alias("ordinal", *kinds))
            parts.append(found.where("whole is not null or real is not null or text is not null").select("*", *flags))
    spark = tables[names[0]].sparkSession
    if not parts:
        return local_table(spark, [], "column string, family string, members array<int>, n bigint")
    values = reduce(DataFrame.unionByName, parts).groupBy("ordinal", *kinds).agg(*[F.bit_or(w).alias(w) for w in words])
    family = F.when(F.col("whole").isNotNull(), "whole").when(F.col("real").isNotNull(), "real").otherwise("text")
    sets = values.groupBy("ordinal", family.alias("family"), *words).agg(F.count("*").alias("n"))
    members = F.array_compact(F.array(*[
        F.when(F.col(words[i // WORD_BITS]).bitwiseAND(F.lit(1 << (i % WORD_BITS)).cast("bigint")) != 0, F.lit(i))
        for i in range(len(names))]))
    named = local_table(spark, list(enumerate(columns)), "ordinal int, column string")
    return sets.join(F.broadcast(named), "ordinal").select("column", "family", members.alias("members"), "n")


def shared_values(index: DataFrame) -> DataFrame:
    """Rows (column, family, a, b, n): distinct values that the tables number a and b, a <= b, have in common."""
    pairs = index.select("column", "family", "n", "members", F.posexplode("members").alias("_i", "a")).select(
        "column", "family", "n", "a", F.explode(F.expr("slice(members, _i + 1, size(members) - _i)")).alias("b"))
    return pairs.groupBy("column", "family", "a", "b").agg(F.sum("n").alias("n"))


def row_overlap(a: DataFrame, b: DataFrame, key: str = None) -> DataFrame:
    """One row (row_overlap, key_info): Jaccard of key values in percent; without a key the mean share
    of common values over the common numeric columns."""
    if key:
        return key_overlap(a, b, key).select(
            F.coalesce(F.try_divide(F.col("n_both") * 100.0, F.col("n_either").cast("double")), F.lit(0.0))
            .alias("row_overlap"),
            F.when(F.col("n_either") > 0, F.concat(
                F.lit(f"Matched primary key '{key}' with "), F.col("n_both").cast("string"),
                F.lit(" overlapping records."))).otherwise(F.lit(NO_KEY)).alias("key_info"))
    share = F.coalesce(F.try_divide(F.col("n_both").cast("double"), F.greatest("n_a", "n_b").cast("double")), F.lit(0.0))
    return value_overlap(a, b).agg(
        F.coalesce(F.avg(share) * 100.0, F.lit(0.0)).alias("row_overlap")).withColumn("key_info", F.lit(NO_KEY))


def correlation_similarity(a: DataFrame, b: DataFrame) -> float:
    """100 minus half the mean absolute difference of the two correlation matrices, in percent."""
    shared = [c for c in common_columns(a, b) if is_numeric(dtype_of(a, c)) and is_numeric(dtype_of(b, c))]
    if len(shared) < 2:
        return 100.0
    ra, rb = together(a.sparkSession, *[
        lambda df=df: correlation_dict(normalize(df.select(*[col(c) for c in shared])), shared) for df in (a, b)])
    return matrix_similarity(ra, rb, shared)


def matrix_similarity(ra: dict, rb: dict, shared: list) -> float:
    """The same from two upper triangles ``{(x, y): r}`` that hold the columns ``shared`` in any order."""
    if len(shared) < 2:
        return 100.0

    def r(matrix, x, y):
        return matrix[x, y] if (x, y) in matrix else matrix[y, x]

    total = sum(abs(r(ra, x, y) - r(rb, x, y)) * (1 if x == y else 2) for i, x in enumerate(shared) for y in shared[i:])
    return max(0.0, 100.0 * (1.0 - total / len(shared) ** 2 / 2.0))


class OrderNeeded(ValueError):
    """The answer depends on the order of rows, and none was given."""


def missing_overlap(a: DataFrame, b: DataFrame, order_a=None, order_b=None, parity: bool = False) -> DataFrame:
    """Rows (column, nulls_a, nulls_b, nulls_both, overlap) per common column, rows paired by position.

    Positions are only worked out when some column has NULLs on both sides, and only for NULL flags.
    ``parity`` leaves out B's NULLs past the end of a shorter A.
    """
    a, b = normalize(a), normalize(b)
    common = common_columns(a, b)
    schema = "column string, nulls_a bigint, nulls_b bigint, nulls_both bigint, overlap double"
    na, nb = ({c: v for c, v in agg_row(df, {c: F.count_if(col(c).isNull()) for c in common}).items()}
              if common else {} for df in (a, b))
    shared = [c for c in common if na[c] and nb[c]]
    both = {c: 0 for c in common}
    tail = {c: 0 for c in common}
    needs_tail = parity and any(nb[c] for c in common)
    watched = [c for c in common if nb[c]] if needs_tail else shared
    if watched:
        if not (order_a and order_b):
            raise OrderNeeded("pairing rows by position needs order_a and order_b")
        (left, n_a), (right, _) = together(
            a.sparkSession, lambda: _null_flags(a, watched, order_a, "l"), lambda: _null_flags(b, watched, order_b, "r"))
        if shared:
            met = left.join(right, F.col("_l") == F.col("_r")).agg(*[
                F.count_if(F.col(f"l{i}") & F.col(f"r{i}")).alias(c) for i, c in enumerate(watched)]).first()
            both.update({c: met[i] for i, c in enumerate(watched)})
        if needs_tail:
            past = right.where(F.col("_r") >= n_a).agg(*[
                F.count_if(F.col(f"r{i}")).alias(c) for i, c in enumerate(watched)]).first()
            tail.update({c: past[i] for i, c in enumerate(watched)})
    rows = []
    for c in common:
        either = na[c] + nb[c] - tail[c] - both[c]
        rows.append((c, na[c], nb[c], both[c], 100.0 * both[c] / either if either else 100.0))
    return local_table(a.sparkSession, rows, schema)


def _null_flags(df: DataFrame, columns: list, order_by, side: str) -> tuple:
    """Positions of the rows with a NULL in ``columns``, with one flag per column."""
    flags = [f"{side}{i}" for i in range(len(columns))]
    keys = [f"k{i}" for i in range(len(order_by))]
    slim = df.select(*[col(c).isNull().alias(f) for c, f in zip(columns, flags)],
                     *[col(k).alias(x) for k, x in zip(order_by, keys)], tie_digest(df).alias("tie"))
    placed, n = indexed(slim, [*keys, "tie"], f"_{side}", keep=flags)
    some = F.col(flags[0])
    for f in flags[1:]:
        some = some | F.col(f)
    return placed.where(some), n


# ---------------------------------------------------------------- names and types

def name_matches(a: DataFrame, b: DataFrame) -> list:
    """(column of A, best ratio against the columns of B)."""
    return list(zip(a.columns, best_of(a.columns, b.columns)))


def name_similarity(pairs: DataFrame) -> DataFrame:
    """Add ``column_name_similarity`` to rows holding the arrays ``names_a`` and ``names_b``."""
    best = best_ratios(F.col("names_a"), F.col("names_b"))
    mean = F.try_divide(F.aggregate("_best", F.lit(0.0), lambda s, x: s + x), F.size("_best").cast("double"))
    return pairs.withColumn("_best", best).withColumn(
        "column_name_similarity", F.coalesce(mean * 100.0, F.lit(0.0))).drop("_best")


def name_levenshtein(pairs: DataFrame) -> DataFrame:
    """As ``name_similarity`` with edit distance over the longer name; no Python, not the same number."""
    def ratio(x, y):
        return 1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))

    best = F.transform("names_a", lambda x: F.coalesce(
        F.array_max(F.transform("names_b", lambda y: ratio(x, y))), F.lit(0.0)))
    mean = F.try_divide(F.aggregate(best, F.lit(0.0).cast("double"), lambda s, x: s + x),
                        F.size("names_a").cast("double"))
    return pairs.withColumn("column_name_similarity", F.coalesce(mean * 100.0, F.lit(0.0)))


def schema_scores(a: DataFrame, b: DataFrame) -> dict:
    """The four similarities that only need names and types, in percent."""
    common, new = common_columns(a, b), only_in_first(b, a)
    width_a, width_b = len(a.columns), len(b.columns)
    either = width_a + len(new)
    best = [r for _, r in name_matches(a, b)]
    return {
        "schema_similarity": 100.0 * len(common) / either if either else 0.0,
        "column_name_similarity": 100.0 * sum(best) / len(best) if best else 0.0,
        "dtype_compatibility": 100.0 * sum(same_kind(a, b, c) for c in common) / len(common) if common else 0.0,
        "common_columns_ratio": 100.0 * len(common) / max(width_a, width_b) if either else 0.0,
        "unique_feature_gain": 100.0 * len(new) / width_a if width_a else 0.0,
    }


# ---------------------------------------------------------------- the comparison

PAIR_COMPAT = (
    "dataset_a string, dataset_b string, schema_similarity double, column_name_similarity double, "
    "dtype_compatibility double, common_columns_ratio double, unique_feature_gain double, row_overlap double, "
    "correlation_similarity double, missing_value_overlap double, primary_key string, key_info string, "
    "common_columns array<string>, new_columns array<string>, compatibility_score double"
)


def compare(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b", order_a=None, order_b=None,
            parity: bool = False, rename: bool = True) -> DataFrame:
    """One row: all similarities of A and B, unrounded, and the weighted compatibility score.

    ``missing_value_overlap`` is NULL when it depends on row order and none is given.
    """
    if rename:
        a, b = clean_names(a), clean_names(b)
        order_a, order_b = ([clean_name(k) for k in o] if o else None for o in (order_a, order_b))
    a, b = normalize(a), normalize(b)
    scores = schema_scores(a, b)

    def keyed():
        key = find_key(a, b)
        return key, row_overlap(a, b, key).first()

    def missing():
        try:
            found = [r["overlap"] for r in missing_overlap(a, b, order_a, order_b, parity).collect()]  # per column
        except OrderNeeded:
            return None
        return sum(found) / len(found) if found else 100.0

    (key, overlap), scores["correlation_similarity"], scores["missing_value_overlap"] = together(
        a.sparkSession, keyed, lambda: correlation_similarity(a, b), missing)
    scores["row_overlap"] = overlap["row_overlap"]
    return local_table(a.sparkSession, [pair_row(a, b, name_a, name_b, scores, key, overlap["key_info"])], PAIR_COMPAT)


def pair_row(a: DataFrame, b: DataFrame, name_a: str, name_b: str, scores: dict, key, key_info: str) -> tuple:
    """A row of ``PAIR_COMPAT``."""
    total = sum(w * scores[k] for k, w in COMPATIBILITY_WEIGHTS.items())
    return (name_a, name_b, *[scores[k] for k in (
        "schema_similarity", "column_name_similarity", "dtype_compatibility", "common_columns_ratio",
        "unique_feature_gain", "row_overlap", "correlation_similarity", "missing_value_overlap")],
        key, key_info, common_columns(a, b), only_in_first(b, a), min(100.0, max(0.0, total)))


def pairs(datasets: DataFrame) -> DataFrame:
    """All unordered pairs of the rows (dataset, ordinal), ordinals 0..n-1, by an equi-join on the partner."""
    last = datasets.agg(F.max("ordinal")).first()[0]
    left = datasets.where(F.col("ordinal") < F.lit(last)).select(
        F.col("dataset").alias("dataset_a"),
        F.explode(F.sequence(F.col("ordinal") + 1, F.lit(last))).alias("ordinal"))
    return left.join(datasets.select("ordinal", F.col("dataset").alias("dataset_b")), "ordinal").select(
        "dataset_a", "dataset_b")


def compare_all(tables: dict, order_by: dict = None) -> DataFrame:
    """``compare`` for every unordered pair of the named tables.

    Each table is counted once and correlated once, the values of all tables meet in one inverted index, and a
    pair is then arithmetic on those; only the positions of NULLs, where an order is given, are joined by pair.
    """
    spark = next(iter(tables.values())).sparkSession
    order_by = {n: [clean_name(k) for k in o] for n, o in (order_by or {}).items() if o}
    names = list(tables)
    tables = {n: normalize(clean_names(df)) for n, df in tables.items()}
    couples = list(combinations(names, 2))
    common = {p: common_columns(*[tables[n] for n in p]) for p in couples}
    key = {p: key_by_name(common[p]) for p in couples}
    wanted = {n: set() for n in names}
    for p in couples:
        for n in p:
            wanted[n] |= {key[p]} if key[p] else set(common[p])
    wanted = {n: [c for c in df.columns if c in wanted[n]] for n, df in tables.items()}
    partners = {n: set().union(*[common[p] for p in couples if n in p]) if len(names) > 1 else set() for n in names}

    def facts(n):
        return agg_row(tables[n], {"*": F.count(F.lit(1)), **{(c, "n"): F.count(col(c)) for c in tables[n].columns}})

    def matrix(n):
        shared = [c for c in numeric_names(tables[n]) if c in partners[n]]
        return correlation_dict(tables[n].select(*[col(c) for c in shared]), shared) if len(shared) > 1 else {}

    jobs = [lambda: shared_values(value_index(tables, wanted)).collect(),  # one row per column and pair
            *[lambda n=n: facts(n) for n in names], *[lambda n=n: matrix(n) for n in names]]
    found, *rest = together(spark, *jobs)
    seen, corr = dict(zip(names, rest)), dict(zip(names, rest[len(names):]))
    both = {(r["column"], r["family"], names[r["a"]], names[r["b"]]): r["n"] for r in found}
    families = value_families(tables, wanted)
    nulls = _placed_nulls(tables, seen, common, order_by)

    def counts(c, x, y):
        """Distinct values of x, of y, of both."""
        shared = [f for f in families[x, c] if f in families[y, c]]
        own = [both.get((c, families[n, c][0], n, n), 0) for n in (x, y)]
        return (*own, both.get((c, shared[0], x, y), 0) if shared else 0)

    def unique(c, n):
        return seen[n][c, "n"] == seen[n]["*"] == both.get((c, families[n, c][0], n, n), 0)

    rows = []
    for x, y in couples:
        a, b = tables[x], tables[y]
        scores = schema_scores(a, b)
        chosen = key[x, y] or next((c for c in common[x, y] if unique(c, x) and unique(c, y)), None)
        info = NO_KEY
        if chosen:
            n_a, n_b, n_both = counts(chosen, x, y)
            either = n_a + n_b - n_both
            scores["row_overlap"] = 100.0 * n_both / either if either else 0.0
            if either:
                info = f"Matched primary key '{chosen}' with {n_both} overlapping records."
        else:
            shares = [n_both / max(n_a, n_b) if n_a or n_b else 0.0 for n_a, n_b, n_both in (
                counts(c, x, y) for c in common[x, y] if is_numeric(dtype_of(a, c)) and is_numeric(dtype_of(b, c)))]
            scores["row_overlap"] = 100.0 * sum(shares) / len(shares) if shares else 0.0
        shared = [c for c in common[x, y] if is_numeric(dtype_of(a, c)) and is_numeric(dtype_of(b, c))]
        scores["correlation_similarity"] = matrix_similarity(corr[x], corr[y], shared)
        scores["missing_value_overlap"] = nulls(x, y)
        rows.append(pair_row(a, b, x, y, scores, chosen, info))
    return local_table(spark, rows, PAIR_COMPAT)


def _placed_nulls(tables: dict, seen: dict, common: dict, order_by: dict):
    """A function (x, y) -> mean overlap of NULLs, None without an order that it needs; each table is put in order once."""
    nulls = {(n, c): seen[n]["*"] - seen[n][c, "n"] for n in tables for c in tables[n].columns}
    watched = {p: [c for c in cols if nulls[p[0], c] and nulls[p[1], c]] for p, cols in common.items()}
    columns = {n: [c for c in tables[n].columns if any(n in p and c in cols for p, cols in watched.items())] for n in tables}
    placed = {n: _null_flags(tables[n], columns[n], order_by[n], "f")[0] for n in tables if columns[n] and n in order_by}

    def overlap(x, y):
        cols, met = common[x, y], {}
        if watched[x, y]:
            if x not in placed or y not in placed:
                return None
            left, right = (placed[n].select(F.col("_f").alias(f"_{s}"), *[
                F.col(f"f{columns[n].index(c)}").alias(f"{s}{i}") for i, c in enumerate(watched[x, y])]) for n, s in ((x, "l"), (y, "r")))
            row = left.join(right, F.col("_l") == F.col("_r")).agg(*[
                F.count_if(F.col(f"l{i}") & F.col(f"r{i}")) for i in range(len(watched[x, y]))]).first()
            met = dict(zip(watched[x, y], row))
        shares = []
        for c in cols:
            either = nulls[x, c] + nulls[y, c] - met.get(c, 0)
            shares.append(100.0 * met.get(c, 0) / either if either else 100.0)
        return sum(shares) / len(shares) if shares else 100.0

    return overlap


# ---------------------------------------------------------------- the second comparison

def feature_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Jaccard of the raw names and share of common columns of exactly equal type, in percent."""
    common, mine, theirs = common_columns(a, b), only_in_first(a, b), only_in_first(b, a)
    either = len(common) + len(mine) + len(theirs)
    same = sum(dtype_of(a, c) == dtype_of(b, c) for c in common)
    return local_table(a.sparkSession, [(
        100.0 * len(common) / either if either else 0.0, 100.0 * same / len(common) if common else 0.0,
        common, mine, theirs,
    )], "overlap_percentage double, type_match_percentage double, common_columns array<string>, "
        "unique_to_a array<string>, unique_to_b array<string>")


def complementarity(a: DataFrame, b: DataFrame, order_a, order_b, limit: int = None, per_side: int = None) -> DataFrame:
    """One row: how differently the numeric columns of two tables run when rows are paired by position.

    All numeric columns of both sides take part. For parity, ``per_side=3`` takes the first three by name of
    each side, and ``limit`` pairs only so many leading rows.
    """
    a, b = normalize(a), normalize(b)
    cols_a, cols_b = sorted(numeric_names(a))[:per_side], sorted(numeric_names(b))[:per_side]
    scores = []
    if cols_a and cols_b:
        def placed(df, names, order, side):
            keys = [f"k{i}" for i in range(len(order))]
            slim = df.select(*[as_double(c).alias(f"{side}{i}") for i, c in enumerate(names)],
                             *[col(k).alias(x) for k, x in zip(order, keys)])
            if limit is not None:
                slim = slim.orderBy(*keys).limit(limit)
            return indexed(slim, keys, f"_{side}", keep=[f"{side}{i}" for i in range(len(names))])[0]

        def centred(df, names, order, side):
            found = placed(df, names, order, side)
            return found, agg_row(found, {f"{side}{i}": F.avg(f"{side}{i}") for i in range(len(names))})

        (left, means_a), (right, means_b) = together(a.sparkSession, lambda: centred(a, cols_a, order_a, "l"),
                                                     lambda: centred(b, cols_b, order_b, "r"))
        rows = left.join(right, F.col("_l") == F.col("_r"))
        found = cross_correlation(rows, list(means_a), list(means_b), means_a | means_b)
        scores = [(1.0 - abs(r)) * 100.0 for _, r in sorted(found.items())]
    only_a, only_b = len(only_in_first(a, b)), len(only_in_first(b, a))
    bonus = min(30.0, (only_a + only_b) / max(len(a.columns), len(b.columns)) * 50.0)
    mean = sum(scores) / len(scores) if scores else 50.0
    return local_table(a.sparkSession, [(min(100.0, mean + bonus), only_a, only_b, len(scores))],
                       "complementarity_score double, unique_cols_a int, unique_cols_b int, compared_pairs int")
