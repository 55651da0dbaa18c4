"""Writing runs, flat files, logs and page stores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.functions.text import blank, csv_safe


def flat(df: DataFrame) -> DataFrame:
    """Columns as safe text: lists joined by bars, nulls empty, nested values as JSON."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, " | ")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append((csv_safe(blank(c)) if isinstance(f.dataType, (T.StringType, T.ArrayType, T.MapType, T.StructType)) else blank(c)).alias(f.name))
    return df.select(*out)


def to_csv(df: DataFrame, path: str) -> None:
    """A flat CSV with a header."""
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def to_json(df: DataFrame, path: str, run_id: str, generated_at: str) -> None:
    """Records as JSON lines in the run's folder, with their number and the run in a manifest beside them."""
    df.write.mode("overwrite").json(f"{path}/records")
    df.sparkSession.read.json(f"{path}/records", schema=df.schema).agg(F.lit(run_id).alias("run_id"), F.lit(generated_at).alias("generated_at"), F.count("*").alias("record_count")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def to_pages(pages: DataFrame, path: str) -> None:
    """Indexed pages; a record that is written again replaces its own pages only."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)


def to_version(df: DataFrame, path: str, version: int, expected: int) -> None:
    """A table as a new version, refused if another writer was there first.

    Rows are written beside the versions and take their place by one rename, which of two writers only one can do.
    """
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = lambda n: jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}")
    fs = at(version).getFileSystem(conf)
    if version != expected + 1 or fs.exists(at(version)) or expected and not fs.exists(at(expected)):
        raise RuntimeError(f"version {version} of {path} does not follow what is there")
    aside = f"{path}/_writing-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    source, target = jvm.org.apache.hadoop.fs.Path(aside), at(version)
    # Renaming onto a folder that has appeared since would move into it.
    if fs.exists(target) or not fs.rename(source, target) or fs.exists(jvm.org.apache.hadoop.fs.Path(target, source.getName())):
        fs.delete(source, True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(target, source.getName()), True)
        raise RuntimeError(f"version {version} of {path} was written by another")


def discovery(results: DataFrame, counts: DataFrame, preview: DataFrame, path: str) -> None:
    """The four outputs of a discovery run."""
    results.write.mode("overwrite").json(f"{path}/results_json")
    to_csv(results, f"{path}/results_csv")
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/log")
    preview.write.mode("overwrite").parquet(f"{path}/registry_preview")
