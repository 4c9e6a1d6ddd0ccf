"""A cube's statistics as a table that micro-batches of score rows are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.cube import Mesh


def merge(plan: Mesh, rows: DataFrame, folder: str, batch: int) -> None:
    """Adds a batch of rows. Its statistics are a partition of each table, named by the batch and written anew, so a batch
    that is replayed after a failure changes nothing."""
    for name, part in plan.statistics(rows).items():
        part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def maintain(plan: Mesh, stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Merges whatever a stream of score rows has, batch by batch."""
    write = lambda rows, batch: merge(plan, rows, folder, batch)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def maintained(spark: SparkSession, plan: Mesh, folder: str) -> dict[str, DataFrame]:
    """The statistics of all batches so far, for plan.cells."""
    # the schema is that of the plan's own statistics, so tables without a row are read too
    return {name: spark.read.schema(part.schema).parquet(f"{folder}/{name}").select(*part.columns) for name, part in plan.statistics(plan.cuboid.flat).items()}


def compact(spark: SparkSession, plan: Mesh, folder: str, target: str) -> None:
    """Writes the statistics of all batches as one batch of a new table, keys and values summed up."""
    for name, part in maintained(spark, plan, folder).items():
        merged = plan.merged.merges if name == "sums" else {"m": F.sum("m")}
        by = [c for c in part.columns if c not in merged]
        part.groupBy(*by).agg(*[f.alias(c) for c, f in merged.items()]).write.parquet(f"{target}/{name}/batch=0")
