"""Spark session helpers.

The library never creates machine-local scratch paths on a cluster: lineage
is cut with ``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``.  Only a local/test session (where the setting is
unset) gets a fresh temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Conf applied to sessions built by this module.  On a cluster the operator
# sizes shuffle partitions for the data (roughly input bytes / 128 MB); AQE
# then coalesces small partitions and splits skewed ones at run time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Answer parsing and scoring build wide CASE / higher-order-function
    # expressions; constraint propagation re-derives them through every
    # filter and projection and can explode planning time.  Explicit
    # predicates are still pushed to the scans.
    "spark.sql.constraintPropagation.enabled": "false",
}
# Runtime SQL settings applied to any session the library is handed.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.constraintPropagation.enabled": "false",
    # The JVM never compiles a method above 8,000 bytes, and whole-stage code puts a wide
    # projection into one; above the limit Spark splits the work into methods that are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings and make sure a checkpoint folder exists."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quire", extra: dict | None = None) -> SparkSession:
    """Return a session with the library defaults (local master for tests)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset.

    A local master is the only case where a temporary folder is acceptable.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="quire-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


#: Rows of a narrow numeric frame that one task of a training pass takes.
ROWS_A_TASK = 250_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """The same rows in two partitions for each core, or more where ``rows`` is large; no shuffle.

    Trainers pass over their frame hundreds of times.  In the partitions a shuffle leaves behind, a
    pass costs the starts of many tiny tasks rather than the rows."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows as Parquet in the shared checkpoint folder, read back.

    For frames that many passes read, each a few columns: a pass decodes these only, and their size is
    known to the planner.  ``cut_lineage`` keeps the partitions, but every pass reads whole rows."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "quire-stored", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
