"""Graphs without a driver-side graph: connected components, and decisions that depend on earlier ones.

Components are joined in one task where edges are few, by alternating star contractions beyond. Rows that take keys in order
(``first_come``) are settled in rounds: whoever is first for all of its keys takes them, whoever wants a taken key is out.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Edges that one task joins; it holds them in some tens of megabytes.
ONE_TASK = 300_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sieveworks-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, until the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: list, name: str = "place", start: int = 1) -> DataFrame:
    """``df`` with ``name``: its rows' numbers in an order over the whole table.

    Rows are sorted over ranges, and numbered by their place in a range and the counts of the ranges before it; no task sees
    them all. The sorted rows are written once, as their numbers depend on how they were dealt.
    """
    sorted_ = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = sorted_.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + start).select(*df.columns, name)


#: Rows of a key that one task numbers.
HOT = 1 << 18


def numbered(df: DataFrame, key: str, order: list, name: str, hot: int = HOT) -> DataFrame:
    """``df`` with ``name``: its rows' numbers from 1 in an order inside each value of ``key``, which is never null.

    Keys of up to ``hot`` rows are numbered in their task. The rows of larger ones are sorted over ranges of (key, order); a row's
    number is its place in its range's part of the key and the counts of that key in the ranges before, so no task sees a key whole.
    """
    large = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(key)
    inside = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if large.isEmpty():
        return df.withColumn(name, inside)
    large = written(large, "hot")
    few = df.join(large, key, "left_anti").withColumn(name, inside)
    ranged = df.join(large, key, "left_semi").orderBy(key, *order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = written(ranged, "ranges").withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted_.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each key and range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(key, "_part", (before - F.col("_first") + 1).alias("_shift"))
    many = sorted_.join(sizes, [key, "_part"]).withColumn(name, (F.col("_at") + F.col("_shift")).cast("int"))
    return few.select(*df.columns, name).unionByName(many.select(*df.columns, name))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of all edges of one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(root.setdefault(u, u)), find(root.setdefault(v, v))
            if a != b:
                root[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in root]
    ends = [(x, r) for x, r in found if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.int64()), pa.array([r for _, r in ends], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``node, root`` for edges ``a, b``: the least node that a node reaches. Nodes are long; a root has no row of its own.

    Up to ``one_task`` edges are joined in one task of an executor; more of them by rounds over all tasks.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if stars.count() <= one_task:
        return stars.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_forest, "node long, root long")
    last = None
    for _ in range(rounds):
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        stars = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = written(stars.join(least, "u").select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct(), "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: Rounds after which rows that still wait for one another go through one task, if they are few.
MOST_ROUNDS = 16


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The loop itself, over rows sorted by (row, key)."""
    owner: dict[str, int] = {}
    now, own = None, []

    def settle() -> None:
        if own and not any(k in owner for k in own):
            owner.update((k, now) for k in own)

    for batch in batches:
        for row, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if row != now:
                settle()
                now, own = row, []
            own.append(key)
    settle()
    yield pa.RecordBatch.from_arrays([pa.array(owner.keys(), pa.string()), pa.array(owner.values(), pa.int64())], names=["key", "owner"])


def first_come(keys: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``key, owner``: the row that takes a key, where rows in order take all of their keys if none of them is taken yet.

    ``keys`` has ``row long, key string``. The loop's result comes from rounds: a row that is first for each of its keys among
    those that wait takes them, and all others that want one of these are out. A key that very many rows want is summed to its
    first row before it is dealt, and settled with it. Rows wait in line only along chains of different keys, so rounds are few;
    up to ``one_task`` keys of rows that share any, or that still wait after ``MOST_ROUNDS`` rounds, go through one task.
    """
    waiting = written(keys.where("key is not null").select(F.col("row").cast("long").alias("row"), F.col("key").cast("string").alias("key")).distinct(), "keys")
    shared = waiting.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("owner"))
    linked = waiting.join(shared.where("n > 1").select("key"), "key", "left_semi").select("row").distinct()
    taken = waiting.join(linked, "row", "left_anti").select("key", F.col("row").alias("owner"))
    waiting = written(waiting.join(linked, "row", "left_semi"), "waiting")
    for n in range(1 << 16):
        left = waiting.count()
        if not left:
            return taken
        if left <= one_task and n in (0, MOST_ROUNDS):
            return taken.unionByName(waiting.select("row", "key").coalesce(1).sortWithinPartitions("row").mapInArrow(_taken, "key string, owner long"))
        first = waiting.join(waiting.groupBy("key").agg(F.min("row").alias("m")), "key").groupBy("row").agg(F.min(F.col("m") == F.col("row")).alias("all")).where("all").select("row")
        new = written(waiting.join(first, "row").select("key", F.col("row").alias("owner")), "taken")
        taken = taken.unionByName(new)
        out = waiting.join(new.select("key"), "key", "left_semi").select("row").distinct()
        waiting = written(waiting.join(out, "row", "left_anti"), "waiting")
    raise RuntimeError("rows did not settle")
