"""Shared plumbing of the training-data operators: scratch tables, row keys, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters A-Z become a-z, every other byte stays.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_own_folder: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder all executors share (spark.checkpoint.dir). Where that is unset, a temporary folder serves if
    all tasks run on this machine, and it is an error if they don't: each executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the plans run within are deleted as each of them ends, as their result is written by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as Parquet in the scratch folder and return it as read back, with its path: lineage ends here and lost executors cost nothing.
    What drop_scratch() hasn't deleted by then goes when the driver ends."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    with tidy_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def shielded(docs: DataFrame, *taken: str) -> tuple[DataFrame, list]:
    """docs with the columns that are named, case aside, like one in `taken` under other names, and the columns that give
    the old names back."""
    used, names = {c.lower() for c in docs.columns} | {t.lower() for t in taken}, []
    for c in docs.columns:
        new = c
        if c.lower() in {t.lower() for t in taken}:
            new = f"{c}_own"
            while new.lower() in used:
                new += "_"
            used.add(new.lower())
        names.append(new)
    return docs.toDF(*names), [F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)]
