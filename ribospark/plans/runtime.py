"""Session defaults and lineage cutting.

``cut`` writes a DataFrame to the checkpoint folder that every executor shares,
so a lost executor never loses the only copy of an intermediate table.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "ribospark", cores: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own, or a temporary one in plain local mode.

    On a cluster without ``spark.checkpoint.dir`` this raises: a machine-local
    folder would not be visible to the other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ribospark-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


#: Seconds between two collections of the driver's garbage, and when the last one was.
COLLECT_EVERY = 3.0
_collected = [0.0]


#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 1000


def bound_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """From now on the session's Arrow batches hold ``rows`` rows at most; a lower setting stays.

    Spark's 10,000 texts go to Python and back as one batch each way, which the executor and
    the worker hold several times (buffers are doubled as they fill, the next batch comes
    while the last one is still held): hundreds of MB for each executor outside its heap.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The driver then collects its garbage (unless it just did), so that shuffle files and
    checkpoints that nothing refers to any more leave the executors' disks now and not only
    once the driver's memory happens to be short.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    _collect_garbage(spark)
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed table in the shared checkpoint folder: a few times smaller than what ``cut`` writes."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Slots of the table that ``maybe_among`` broadcasts, whatever the number of keys.
SLOTS = 1 << 20


def maybe_among(df: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``columns`` equal a row of ``keys``, and by chance a few others.

    It keeps rows that can't be concerned out of a shuffle; what passes is still to be joined. At most
    ``SLOTS`` numbers are broadcast; with many more keys than that most rows pass.
    """
    slot = lambda names: F.pmod(F.xxhash64(*names), F.lit(SLOTS)).cast("int")
    taken = keys.select(slot(keys.columns).alias("_slot")).distinct()
    return df.join(F.broadcast(taken), slot(columns) == F.col("_slot"), "left_semi")


def _collect_garbage(spark: SparkSession) -> None:
    if time.monotonic() - _collected[0] > COLLECT_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()
