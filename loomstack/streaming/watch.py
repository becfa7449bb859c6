"""File-change streams: event types, filters, debounce and batches; the same functions serve batch and streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstack.functions.storage import Table
from loomstack.sources.files import is_ignored

WATCHED = r"\.(ts|tsx|js|jsx|mjs|cjs|vue|py|go|rs|java|kt|php|rb|cs|cpp|c|h|hpp|swift|scala|dart|svelte)\z"


def watched_events(events: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Events (type, path, ts) on source files outside ignored folders."""
    return events.where(F.col("path").rlike(WATCHED) & ~is_ignored(F.col("path"), list(ignore)))


def debounce(events: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(path, type, ts, n): of events on a path at most ``gap`` apart the last one's type and time."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.max_by("type", "ts").alias("type"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))
    return out.select("path", "type", "ts", "n", "first_ts")


def reindex_batches(changes: DataFrame, gap: str = "1 second") -> DataFrame:
    """(first_ts, ts, changes): debounced changes of all paths at most ``gap`` apart.

    In batch the changes of each ``gap`` of time are put together first, as
    they are in one batch anyway; only these rows, at most one for each such
    time, are then looked at in order.
    """
    if changes.isStreaming:
        out = changes.groupBy(F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("changes"))
        return out.select("first_ts", "ts", "changes")
    slots = changes.groupBy(F.window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("changes"))
    before = F.lag("ts").over(W.orderBy("first_ts"))
    fresh = F.when(before.isNull() | (F.col("first_ts") > before + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    batch = F.sum("fresh").over(W.orderBy("first_ts").rowsBetween(W.unboundedPreceding, 0))
    return slots.withColumn("fresh", fresh).withColumn("batch", batch).groupBy("batch").agg(F.min("first_ts").alias("first_ts"), F.max("ts").alias("ts"), F.sum("changes").alias("changes")).drop("batch")


def watch_folder(spark: SparkSession, folder: str, schema: str = "type string, path string, ts timestamp") -> DataFrame:
    """A stream of events from JSON files that appear in a folder."""
    return spark.readStream.schema(schema).json(folder)


def start(events: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "300 milliseconds", once: bool = False):
    """Run ``on_batch`` with the debounced changes of each micro-batch."""
    writer = debounce(watched_events(events), gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counters(events: DataFrame) -> DataFrame:
    """(total, added, changed, deleted, last_change)."""
    n = lambda t: F.count_if(F.col("type") == t)
    return events.agg(F.count(F.lit(1)).alias("total"), n("add").alias("added"), n("change").alias("changed"), n("delete").alias("deleted"), F.max("ts").alias("last_change"))


#: Events of one range of the order.
RANGE = 1 << 18


def watched_files(events: DataFrame) -> DataFrame:
    """(root, ts, watched): files watched after each event of a top folder; an add counts 1, a delete -1, never below 0.

    The clamped sum is the running sum less its least value so far, if negative.
    Events are cut into ranges of their order (ts, path, type, then any), summed
    in each, and the sums and least values of a folder's earlier ranges added.
    """
    ranges = events.count() // RANGE + 1
    step = F.when(F.col("type") == "add", 1).when(F.col("type") == "delete", -1).otherwise(0)
    rows = events.select(F.substring_index("path", "/", 1).alias("root"), "ts", "path", "type", step.alias("d"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(ranges, "root", "ts", "path", "type", "row").withColumn("part", F.spark_partition_id()).repartition(ranges, "part")
    order = W.partitionBy("part", "root").orderBy("ts", "path", "type", "row").rowsBetween(W.unboundedPreceding, 0)
    sums = Table(ranged.withColumn("s", F.sum("d").over(order)).withColumn("m", F.min("s").over(order)).select("part", "root", "ts", "d", "s", "m"), "watched").df
    before = W.partitionBy("root").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sums.groupBy("root", "part").agg(F.sum("d").alias("d"), F.min("s").alias("m")).withColumn("s0", F.coalesce(F.sum("d").over(before), F.lit(0)))
    # In a range at most one folder has gone on from an earlier one.
    earlier = parts.select(F.col("root").alias("r"), F.col("part").alias("p"), "s0", F.min(F.col("s0") + F.col("m")).over(before).alias("low")).where("low is not null")
    s0, low = F.coalesce("s0", F.lit(0)), F.coalesce("low", F.lit(0))
    out = sums.join(F.broadcast(earlier), (F.col("part") == F.col("p")) & F.col("root").eqNullSafe(F.col("r")), "left")
    return out.select("root", "ts", (F.col("s") + s0 - F.least(F.lit(0), low, F.col("m") + s0)).alias("watched"))
