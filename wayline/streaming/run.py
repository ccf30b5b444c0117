"""Running streams to the end of the available input and reading what they wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path, settle

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # merge sessions before the shuffle, so that a busy camera sends few rows
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def file_stream(spark: SparkSession, folder: str, table: str, per_trigger: int = 1000) -> DataFrame:
    """Stream over the Parquet files of one table, a single file or a folder of parts."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern the path may be either; a plain stream path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path}*")


def drain(
    stream: DataFrame, label: str, mode: str = "append", checkpoint: str | None = None, out: str | None = None,
    step: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Process everything available, then return all output rows with ``batch_id``.

    Each micro-batch overwrites its own folder, so a batch run again after a failure
    leaves its rows once. ``step`` may reshape a batch before it is written.
    """
    spark = stream.sparkSession
    resumed = out
    out = out or scratch_path(spark, f"{label}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{label}-checkpoint")
    # an empty micro-batch only has a watermark to act on; state with processing time would ask for them without end
    timed = "EventTimeWatermark" in stream._jdf.queryExecution().analyzed().toString()
    settings = SETTINGS | {"spark.sql.streaming.noDataMicroBatches.enabled": str(timed).lower()}
    before = {k: spark.conf.get(k, None) for k in settings}
    wrote = []
    for k, v in settings.items():
        spark.conf.set(k, v)

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = step(batch, batch_id) if step else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        wrote.append(batch_id)

    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(keep).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    if not wrote and resumed is None:
        return spark.createDataFrame([], stream.schema).withColumn("batch_id", F.lit(0))
    return spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")


def newest(rows: DataFrame, *keys: str) -> DataFrame:
    """Final value per key of an update-mode output."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_v")).select(*keys, "_v.*")


def newest_batch(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows of each key's last batch."""
    last = rows.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, [*keys, "batch_id"], "left_semi").drop("batch_id")


MARK = ["camera_id", "asset_set"]
_CURSORS = "camera_id BIGINT, asset_set STRING, last_seen STRING, handled BIGINT, failed BIGINT"


def cursors_before(spark: SparkSession, place: str, batch_id: int) -> DataFrame:
    """The cursor table that the batch before left; the first batch finds an empty one."""
    if batch_id == 0:
        return spark.createDataFrame([], _CURSORS)
    return spark.read.schema(_CURSORS).parquet(f"{place}/version={batch_id - 1}")


def attempt(rows: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, bit: int = 0) -> StructType:
    """Write ``work(rows)`` below ``path`` and give its schema; where it raises, halve the rows until the failing recordings stand alone.

    Those are written with the exception's text as their ``error`` and no results; all others are worked on as usual."""
    done = work(rows)
    part = f"{path}/part={uuid.uuid4().hex}"
    try:
        done.write.mode("overwrite").parquet(part)
        return done.schema
    except Exception as failure:  # whatever ``work`` raises is the recording's error
        text = str(failure)[:1000]
    if bit == 63 or len(rows.select("recording_id").distinct().take(2)) < 2:
        held = set(rows.columns)
        failed = [
            F.lit(text).alias("error") if f.name == "error" else (F.col(f.name) if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in done.schema.fields
        ]
        rows.select(*failed).write.mode("overwrite").parquet(part)
        return done.schema
    side = F.shiftright(F.xxhash64("recording_id"), bit).bitwiseAND(F.lit(1))
    for half in (0, 1):
        attempt(rows.filter(side == half), work, path, bit + 1)
    return done.schema


def process_new(
    spark: SparkSession, arrivals: DataFrame, work: Callable[[DataFrame], DataFrame], label: str,
    checkpoint: str | None = None, out: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Process recordings above the mark of their camera and asset set; a later call with the same folders goes on.

    ``arrivals`` streams camera_id, asset_set and recording_id. ``work`` adds ``error`` (NULL when fine); a recording on which
    it raises gets the exception's text there and holds no other one up. Recordings at or below the mark, and repeated ones,
    are skipped. The mark is the highest recording handled, failed ones included. Returns the processed rows and the cursors.

    Cursors are a table with one row a mark. Each batch reads the version before its own and writes its own, so a batch run
    again after a failure finds the same marks, and no batch looks at what earlier ones put out.
    """
    out = out or scratch_path(spark, f"{label}-out")
    place = f"{out.rstrip('/')}-cursors"

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        known = cursors_before(spark, place, batch_id)
        above = batch.join(known.select(*MARK, "last_seen"), MARK, "left")
        above = above.filter(F.col("last_seen").isNull() | (F.col("recording_id") > F.col("last_seen"))).drop("last_seen")
        fresh = settle(above.dropDuplicates([*MARK, "recording_id"]), f"{label}-fresh")
        parts = scratch_path(spark, f"{label}-parts")
        schema = attempt(fresh, work, parts)
        done = spark.read.schema(schema).parquet(f"{parts}/part=*")
        moved = done.groupBy(*MARK).agg(
            F.max("recording_id").alias("last_seen"), F.count(F.lit(1)).alias("handled"), F.count("error").alias("failed")
        )
        merged = known.unionByName(moved).groupBy(*MARK).agg(
            F.max("last_seen").alias("last_seen"), F.sum("handled").alias("handled"), F.sum("failed").alias("failed")
        )
        merged.write.mode("overwrite").parquet(f"{place}/version={batch_id}")
        return done

    done = drain(arrivals, label, checkpoint=checkpoint, out=out, step=step)
    last = done.agg(F.max("batch_id").alias("n")).first()["n"]
    return done, cursors_before(spark, place, 0 if last is None else last + 1)
