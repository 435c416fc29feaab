"""Session helpers: the shared scratch folder, written intermediate tables, one-row aggregates."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Aggregates per job: beyond this, generated code for one agg() grows past what the JIT compiles well.
AGG_BATCH = 120

# Independent jobs submitted at once by one call.
SIDE_BY_SIDE = 8


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="blendscope-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Lists of the open ``scratch`` blocks, innermost last; jobs side by side share them.
_OWNERS: list[list[str]] = []


@contextmanager
def scratch():
    """Delete, at the end of the block, the intermediate tables written in it.

    Results are read from those tables, so write or collect them inside the block.
    """
    mine: list[str] = []
    _OWNERS.append(mine)
    try:
        yield
    finally:
        _OWNERS.remove(mine)
        for path in mine:
            system, place = fs.FileSystem.from_uri(arrow_uri(path))
            if system.get_file_info(place).type == fs.FileType.Directory:
                system.delete_dir(place)


def arrow_uri(path: str) -> str:
    """A folder as Arrow's file systems spell it: Hadoop's names of the S3 scheme are plain ``s3`` there."""
    scheme, mark, rest = path.partition("://")
    return f"s3://{rest}" if mark and scheme.lower() in ("s3a", "s3n") else path


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/blendscope/{label}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later passes see the same rows whatever happens to executors, prune columns, and skip the
    upstream plan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def agg_row(df: DataFrame, exprs: dict, batch: int = AGG_BATCH) -> dict:
    """Run named aggregates over all of ``df``; the answer is one row, however large ``df`` is."""
    names = list(exprs)
    out: dict = {}
    for start in range(0, len(names), batch):
        part = names[start:start + batch]
        row = df.agg(*[exprs[n].alias(f"x{i}") for i, n in enumerate(part)]).first()
        out.update(zip(part, row))
    return out


def together(spark: SparkSession, *calls) -> list:
    """Run independent jobs side by side, so that the tail of one does not idle the cluster."""
    with ThreadPoolExecutor(max_workers=min(len(calls), SIDE_BY_SIDE)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]
        return [job.result() for job in started]


def local_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of metadata (per column, per pair), bounded by schema width rather than by row count."""
    struct = T.StructType.fromDDL(schema)
    fields = to_arrow_schema(struct)
    arrays = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=fields), struct)

