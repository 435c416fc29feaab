"""Column profiles that are kept beside their files and brought up to date by reading only the files that changed.

A store holds, per file of a source, mergeable states: counts, means and sums of squares around the mean per column, value
counts, and counts of row digests. A manifest lists the files (path, size, modification time) whose states make up the profile. States of
a file are written under a name made of these three before the manifest names it, so a run that dies leaves the old profile valid and can
simply be repeated; states that no manifest names any more are passed over.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_double, col, numeric_names
from ..operators.profile import modes_of, outside, profile_rows, require_rows, row_digest, value_counts
from ..operators.quality import components_of, weighted
from ..operators.rowindex import exact_quantiles
from ..session import agg_row, together
from ..sources.io import list_files, normalize


def plain_path(path: Column) -> Column:
    """One spelling of a path, whether it comes from a file listing or, percent-encoded, from a row's metadata."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_back(path: Column) -> Column:
    return plain_path(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def file_id(path: str, size: str, modified: str) -> Column:
    """Fingerprint of a file: another size or time is another file."""
    whole = F.concat_ws("|", F.col(path), F.col(size).cast("string"), F.unix_micros(modified).cast("string"))
    return F.concat(F.lit("f"), F.sha2(whole, 256))  # a folder name that never looks like a number


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, size_bytes, modified, file_id) of the files of a source as they are now. Files are listed, not read."""
    files = list_files(spark, path).withColumn("path", plain_path(F.col("path")))
    return files.withColumn("file_id", file_id("path", "size_bytes", "modified"))


def _stored(spark: SparkSession, path: str):
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def stored_manifest(spark: SparkSession, store: str):
    """The newest manifest of a store, or None."""
    found = _stored(spark, f"{store}/manifest")
    if found is None:
        return None
    newest = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == newest)


def is_current(spark: SparkSession, path: str, store: str) -> bool:
    """True if the stored profile was made of exactly the files that the source has now."""
    known = stored_manifest(spark, store)
    if known is None:
        return False
    now = source_manifest(spark, path).select("file_id")
    apart = now.withColumn("side", F.lit(1)).unionByName(known.select("file_id").withColumn("side", F.lit(-1)))
    return apart.groupBy("file_id").agg(F.sum("side").alias("side")).where("side <> 0").isEmpty()


def _states(spark: SparkSession, changed: DataFrame, schema, store: str) -> None:
    """Write the states of the changed files: one scan for moments, one for value counts, one for digests."""
    files = changed.select("path", "file_id")
    paths = [r["path"] for r in files.collect()]  # file names, as a reader of many files needs them
    raw = spark.read.schema(schema).parquet(*paths)
    named = raw.select("*", read_back(F.col("_metadata.file_path")).alias("_file"))
    tagged = named.join(F.broadcast(files.withColumnRenamed("path", "_file")), "_file").drop("_file")
    data = normalize(tagged)
    columns = [c for c in data.columns if c != "file_id"]
    numeric = set(numeric_names(data)) - {"file_id"}

    def moments():
        parts = [F.count(F.lit(1)).alias("n_rows")]
        for i, c in enumerate(columns):
            parts.append(F.count(col(c)).alias(f"n{i}"))
            if c in numeric:
                x = as_double(c)
                # regr_sxx is the sum of squares around the mean, updated value by value, so it does not cancel.
                parts += [F.avg(x).alias(f"mean{i}"), F.regr_sxx(x, x).alias(f"m2{i}"), F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}")]
        wide = data.groupBy("file_id").agg(*parts)
        cells = [x for i, c in enumerate(columns) for x in (
            F.lit(i), F.lit(c), F.col(f"n{i}"),
            *([F.col(f"{k}{i}") for k in ("mean", "m2", "low", "high")] if c in numeric else [F.lit(None).cast("double")] * 4))]
        return wide.select("file_id", "n_rows", F.stack(F.lit(len(columns)), *cells).alias("ordinal", "column", "n", "mean", "m2", "low", "high"))

    tables = {
        "columns": moments(), "values": value_counts(data, columns, by=["file_id"]),
        "rows": data.select("file_id", *row_digest(data.drop("file_id"))).groupBy("file_id", "_h1", "_h2").agg(F.count("*").alias("n")),
    }
    together(spark, *[
        lambda name=name, df=df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(f"{store}/{name}")
        for name, df in tables.items()])


def refresh(spark: SparkSession, path: str, store: str, schema=None) -> DataFrame:
    """Bring the store up to date with the Parquet files at ``path``; returns the manifest rows of the files that were read.

    Files whose path, size and time are unchanged are not opened. ``schema`` is that of all files; without it, it is taken from one.
    """
    now = source_manifest(spark, path)
    known = stored_manifest(spark, store)
    changed = now if known is None else now.join(known.select("file_id"), "file_id", "left_anti")
    changed = spark.createDataFrame(changed.toArrow(), changed.schema)  # one row per changed file, as they were when listed
    if not changed.isEmpty():
        _states(spark, changed, schema or spark.read.parquet(path).schema, store)
    if known is None or not is_current(spark, path, store):
        version = 0 if known is None else known.agg(F.max("version")).first()[0] + 1
        now.withColumn("version", F.lit(version).cast("bigint")).write.mode("append").partitionBy("version").parquet(f"{store}/manifest")
    return changed


def live(spark: SparkSession, store: str, table: str) -> DataFrame:
    """States of the files that the manifest names. The manifest has one row per file."""
    known = stored_manifest(spark, store)
    if known is None:
        raise FileNotFoundError(f"no stored profile in {store}; refresh it first")
    states = _stored(spark, f"{store}/{table}")
    if states is None:
        raise ValueError("the dataset is empty")
    return states.join(known.select("file_id"), "file_id", "left_semi")


def stored_column_profile(spark: SparkSession, path: str, store: str) -> DataFrame:
    """The column profile of all files, from their states alone: the rows of the source are not read."""
    shape = normalize(spark.read.parquet(path))  # for its schema only
    columns = shape.columns
    states = live(spark, store, "columns")
    n = states.where("ordinal = 0").agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    require_rows(shape, n)
    sums = states.groupBy("ordinal").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                         F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n").cast("double")).alias("mean"))
    # Squares around the common mean: those around each file's own, and the distance of the means.
    apart = states.select("ordinal", "m2", F.col("n").alias("_n"), F.col("mean").alias("_mean")).join(F.broadcast(sums), "ordinal")
    square = F.sum(F.col("m2") + F.col("_n") * (F.col("_mean") - F.col("mean")) * (F.col("_mean") - F.col("mean"))).alias("squares")
    found = {r["ordinal"]: r for r in apart.groupBy("ordinal", "n", "low", "high", "mean").agg(square).collect()}  # one row per column
    numeric = [c for c in columns if c in numeric_names(shape)]
    place = {c: i for i, c in enumerate(columns)}
    facts = {c: (found[place[c]]["n"], found[place[c]]["low"], found[place[c]]["high"]) for c in numeric}
    means = {c: found[place[c]]["mean"] for c in numeric}

    counted = live(spark, store, "values").groupBy("ordinal", "num_value", "dbl_value", "str_value").agg(F.sum("n").alias("n"))
    number = F.coalesce(F.col("dbl_value"), F.col("num_value").cast("double"))
    text_numbers = [place[c] for c in numeric if dict(shape.dtypes)[c].startswith("decimal")]
    if text_numbers:
        number = F.when(F.col("ordinal").isin(text_numbers), F.col("str_value").cast("double")).otherwise(number)
    wide = counted.select(*[F.when(F.col("ordinal") == place[c], number).alias(c) for c in numeric], F.col("n").alias("_times"))

    def spread():
        bounds = {}
        for c, (q1, q3) in exact_quantiles(wide, numeric, [0.25, 0.75], facts, weight="_times").items():
            if q1 is not None:
                bounds[c] = (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        out = agg_row(wide, {(c, "outliers"): F.coalesce(F.sum(F.when(outside(c, b), F.col("_times"))), F.lit(0))
                             for c, b in bounds.items()}) if bounds else {}
        return bounds, out

    (bounds, outliers), modes = together(
        spark, spread, lambda: {r[0]: tuple(r[1:]) for r in modes_of(counted).collect()})  # one row per column
    parts = outliers | {(c, "squares"): found[place[c]]["squares"] for c in numeric}
    return profile_rows(shape, n, {c: found[place[c]]["n"] for c in columns}, facts, means, bounds, parts, modes)


def stored_duplicates(spark: SparkSession, store: str) -> DataFrame:
    """One row: rows, distinct rows, duplicates, from the digests of the rows."""
    copies = live(spark, store, "rows").groupBy("_h1", "_h2").agg(F.sum("n").alias("n"))
    return copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("distinct_rows")).withColumn(
        "duplicate_rows", F.col("n_rows") - F.col("distinct_rows"))


def stored_quality(spark: SparkSession, path: str, store: str, weights: dict = None) -> DataFrame:
    """The quality components and score, brought up to date first."""
    refresh(spark, path, store)
    columns = stored_column_profile(spark, path, store)
    return components_of(columns, stored_duplicates(spark, store).first()["duplicate_rows"]).withColumn("quality_score", weighted(weights))
