"""Helpers of the operators: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Applications that already have this package on their executors, and (application, file name).
_SHIPPED: set[str | tuple[str, str]] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Run the plan once and keep its rows in the shared folder; lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline-package.zip"
    with zipfile.ZipFile(target, "w") as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def ship_file(spark: SparkSession, path: str) -> str:
    """Give the executors a file of the driver's, once an application; SparkFiles knows it by the name returned."""
    context, data = spark.sparkContext, Path(path).read_bytes()
    name = f"{hashlib.sha256(data).hexdigest()[:16]}-{Path(path).name}"
    if (context.applicationId, name) not in _SHIPPED:
        target = Path(tempfile.mkdtemp(prefix="plumbline-")) / name
        target.write_bytes(data)
        context.addFile(str(target))
        _SHIPPED.add((context.applicationId, name))
    return name


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with a function that may use this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def _local_totals(key: int, values: Sequence[int]) -> Callable:
    """Running totals of sorted rows within a partition, for mapInArrow.

    Adds the totals, the partition's number and `edge`: 1 marks its first row, 2 its last one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, edge, last, carry = None, None, None, np.zeros(len(values), np.int64)

        def out() -> pa.RecordBatch:
            names = [*held[0].schema.names, *[f"_{i}" for i in range(len(values))], "_part", "_edge"]
            extra = [*map(pa.array, held[1]), pa.array(np.full(len(edge), part, np.int32)), pa.array(edge)]
            return pa.RecordBatch.from_arrays([*held[0].columns, *extra], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            new = np.r_[last is None or keys[0] != last, keys[1:] != keys[:-1]]
            group = np.cumsum(new) - new[0]
            starts = np.flatnonzero(new) if new[0] else np.r_[0, np.flatnonzero(new)]
            totals = []
            for i, v in enumerate(values):
                one = batch.column(v).to_numpy().astype(np.int64)
                upto = np.cumsum(one)
                before = upto[starts] - one[starts]
                if not new[0]:
                    before[0] -= carry[i]
                totals.append(upto - before[group])
            if held:
                yield out()
            held, edge = (batch, totals), np.zeros(batch.num_rows, np.int32)
            edge[0] = last is None
            last, carry = keys[-1], np.array([t[-1] for t in totals], np.int64)
        if held:
            edge[-1] += 2
            yield out()

    return run


def running_totals(df: DataFrame, key: str, order: Sequence, totals: dict[str, str], cuts: Sequence | None = None) -> DataFrame:
    """df with running totals within a key: for name -> column in `totals`, the total up to the row.

    Rows are dealt by ranges of (key, cuts), where cuts defaults to order, and sorted by (key, order),
    so a key with very many rows lies in many partitions. Each partition adds up its own rows; what
    a key had before comes from one small row of each earlier partition. key: a long without nulls,
    the columns: longs without nulls. `cuts=()` takes the partitions of df as they are: already
    dealt and sorted, as a former call returns them.
    """
    if cuts is None or len(cuts):
        df = df.repartitionByRange(key, *(cuts or order)).sortWithinPartitions(key, *order)
    names = list(totals)
    kinds = [*df.schema.fields, *[StructField(f"_{i}", LongType()) for i in range(len(names))]]
    kinds += [StructField("_part", IntegerType()), StructField("_edge", IntegerType())]
    run = _local_totals(df.columns.index(key), [df.columns.index(c) for c in totals.values()])
    stored = cut(map_arrow(df, run, StructType(kinds)))
    earlier = Window.partitionBy(key).orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    ends = [F.when(F.col("_edge") >= 2, F.col(f"_{i}")).otherwise(0) for i in range(len(names))]
    before = (
        stored.where("_edge > 0")
        .select(key, "_part", "_edge", *[F.sum(e).over(earlier).alias(f"_before{i}") for i, e in enumerate(ends)])
        .where("_edge IN (1, 3) AND _before0 IS NOT NULL")
        .drop("_edge")
    )  # at most one row a partition
    joined = stored.join(F.broadcast(before), [key, "_part"], "left")
    upto = [(F.col(f"_{i}") + F.coalesce(F.col(f"_before{i}"), F.lit(0))).alias(n) for i, n in enumerate(names)]
    return joined.select(*df.columns, *upto)


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of them. Edges have u > v."""
    lowest = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none itself."""
    single = edges.agg((F.count("*") == F.count_distinct("u")).alias("single")).first()["single"]
    return single and edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Node and smallest node of its component, for every node of an edge list (u, v) of longs.

    Alternates large-star and small-star (Kiveris et al. 2014) until every component is a star
    around its smallest node, which takes a number of rounds that is logarithmic in the longest
    chain. Smallest neighbours are combined before their shuffle; the joins read plain shuffled
    rows, so that a node with very many neighbours can be split. Only counts reach the driver.
    """
    edges = cut(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    while not _are_stars(edges):
        edges = cut(_small_star(cut(_large_star(edges))))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
