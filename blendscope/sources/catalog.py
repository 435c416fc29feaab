"""Stored profiles, fusion statistics and history, and the lists made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import source_files

HISTORY_KEY = ["file_a", "file_b", "strategy"]


def list_sources(df: DataFrame) -> DataFrame:
    """Files behind ``df``, newest first."""
    return source_files(df).orderBy(F.col("modified").desc(), "path")


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored result table."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unknown result format: {fmt}")
    return spark.read.format(fmt).load(path)


def save_profile(profile: DataFrame, path: str) -> None:
    """Store profile rows by dataset; only the datasets at hand are replaced."""
    (profile.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset").parquet(path))


def save_stats(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store fusion statistics."""
    stats.write.mode(mode).parquet(path)


def cards(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per source: dataset, size, quality score; ``N/A`` where no profile is stored."""
    known = profiles.select(
        "dataset", F.col("size_text").alias("size"), F.round("quality_score", 2).cast("string").alias("quality_score"))
    return sources.select("dataset").join(known, "dataset", "left").select(
        "dataset", F.coalesce("size", F.lit("N/A")).alias("size"),
        F.coalesce("quality_score", F.lit("N/A")).alias("quality_score"))


def upsert_history(history: DataFrame, new: DataFrame, key=None) -> DataFrame:
    """Latest row per (file_a, file_b, strategy) with ``first_seen``, which is the place in the list; of equal
    times the new one.

    An aggregate, so that a key with very many entries shrinks before it is shuffled.
    """
    keys = HISTORY_KEY if key is None else list(key)
    if "first_seen" not in history.columns:
        history = history.withColumn("first_seen", F.col("ts"))
    rows = history.withColumn("_new", F.lit(0)).unionByName(
        new.withColumn("first_seen", F.col("ts")).withColumn("_new", F.lit(1)))
    rest = [c for c in rows.columns if c not in (*keys, "ts", "first_seen", "_new")]
    latest = F.max(F.struct("ts", "_new", *rest)).alias("_last")
    return rows.groupBy(*keys).agg(latest, F.min("first_seen").alias("first_seen")).select(
        *keys, "_last.ts", *[F.col("_last").getField(c).alias(c) for c in rest], "first_seen")


def recent(history: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest entries of the list."""
    return history.orderBy(F.col("first_seen").desc(), *HISTORY_KEY).limit(n)


def kpis(sources: DataFrame, profiles: DataFrame, history: DataFrame, fused: DataFrame) -> DataFrame:
    """One row: datasets, mean stored quality (1 digit, 0.0 without any), recommendations, fused tables."""
    parts = [
        sources.agg(F.count("*").alias("total_datasets")),
        profiles.join(sources.select("dataset"), "dataset", "left_semi").agg(
            F.coalesce(F.round(F.avg("quality_score"), 1), F.lit(0.0)).alias("avg_quality")),
        history.agg(F.count("*").alias("total_recommendations")),
        fused.agg(F.count("*").alias("total_fused")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")  # one row on each side
    return out.drop("_one")
