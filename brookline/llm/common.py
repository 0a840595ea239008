"""What the operators share: the shared folder, written tables, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimates from which on a size counts as unknown.
UNKNOWN_BYTES = 1 << 56
#: ASCII white space, as the contracts of the text operators name it.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one of our own where that is
    unset. A cluster without it is an error, as its machines would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brookline-"))
            jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: the lineage ends there and lost executors cost nothing. The
    table goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brookline/{name}-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches cut to `rows` rows at most, so that few rows at once become Python objects."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def tasks_for(df: DataFrame, bytes_each: int, most: int = 200_000) -> int:
    """How many tasks of so many bytes df makes by Spark's estimate of its size, as many as shuffle partitions at least. Of what does
    not come from files Spark knows no size (and says one beyond all bounds); shuffle partitions have to do then."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, -(-size // bytes_each))) if size < UNKNOWN_BYTES else least


def unused(name: str, columns: list[str]) -> str:
    """name, or name with as many _ as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one of fewer files than there are cores, and small enough that its files are not split for all of them, is dealt
    out anew, so that one file of one row group does not keep a whole machine waiting. Larger tables are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores, size = spark.sparkContext.defaultParallelism, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 1 << 20 < size < cores << 26 and len(df.inputFiles()) < cores else df


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, root), root the smallest node that is reachable.

    Alternating large-star and small-star steps. A node's smallest neighbour is a partial aggregate and goes back by a
    join, so that a hub never gathers its neighbours in one task (AQE splits the join's hot key). Edges are cut from
    their lineage with checkpoint() in every round. Nodes without an edge have no row. Raises if it does not settle."""
    spark = edges.sparkSession
    shared_dir(spark)

    def settled(df: DataFrame):
        df = df.checkpoint()
        n, mark = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return df, (n, mark)

    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, mark = settled(pairs)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        pairs, now = settled(small)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b"), F.col("b"))).distinct()
