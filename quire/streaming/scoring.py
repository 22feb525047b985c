"""Streaming scoring of pending requests (re-aim of the legacy
read-pending -> predict -> append -> mark-processed loop).

``readStream`` over request files -> ``dropDuplicates`` on the id, whose
state store remembers every id already let through -> the stateless W5 scoring
chain in ``foreachBatch``.  The state is partitioned by id and versioned with the
batches, so a batch reads its own rows and the changes of its state partitions, never the
output written before; nothing is updated in place (S8/J5).  Each batch is written
to its own ``batch_id=`` partition in dynamic-overwrite mode: a batch
replayed after a failure starts from the same state, gives the same rows and replaces its own output.
Progress and state lie in the checkpoint location (shared storage).

The state holds one id for each request ever scored; a long-lived stream sets
``spark.sql.streaming.stateStore.providerClass`` to Spark's RocksDB provider, which keeps it on disk.
Rows without an id count as one id.  An output folder belongs to one checkpoint: a stream
that starts anew over another's output is refused, since it would score those requests again.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.jobs import batch_score
from quire.spec import FK_V1, SurveySpec

PARTITIONS = "spark.sql.shuffle.partitions"


def _refuse_other_output(spark: SparkSession, out_dir: str) -> None:
    """Raise if ``out_dir`` holds later batches than the first (works on any Hadoop filesystem; reads no rows before)."""
    try:
        done = spark.read.parquet(out_dir)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return
        raise
    if "batch_id" in done.columns and not done.where(F.col("batch_id") != 0).isEmpty():
        raise ValueError(f"{out_dir} holds the batches of another checkpoint")


def start_scoring_stream(spark: SparkSession, source_dir: str, schema, out_dir: str,
                         checkpoint_dir: str, model, scaler: dict, features: list[str],
                         spec: SurveySpec = FK_V1, files_per_batch: int = 1, state_partitions: int | None = None):
    """Start the stream; with ``availableNow`` it drains the pending files
    in micro-batches and stops.

    ``state_partitions`` (by default the session's shuffle partitions) is fixed by the checkpoint's first start.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            _refuse_other_output(batch.sparkSession, out_dir)
        # scoring reads the batch twice; the state is worked through once
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scored = batch_score(batch, model, scaler, features, spec)
            (scored.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_dir))
        finally:
            batch.unpersist()

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(source_dir).dropDuplicates(["resp_id"]))
    usual = spark.conf.get(PARTITIONS)
    try:
        if state_partitions is not None:
            spark.conf.set(PARTITIONS, str(state_partitions))
        return (stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_dir)
                .trigger(availableNow=True).start())
    finally:
        spark.conf.set(PARTITIONS, usual)
