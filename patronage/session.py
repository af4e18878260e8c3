"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_PARTS = 10_000
#: Bytes to which shuffle parts are merged at most while a table is stored. Grouped lines take some fifty times as much memory.
MERGED_BYTES = 8 << 20
MERGE_TO = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def build_session(app_name: str = "patronage", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume: AQE, skew-join splitting, UTC.

    Shuffles start with ``SHUFFLE_PARTS`` parts, which adaptive execution merges to its advisory size; callers give
    the number that suits their input (a local run a handful).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": str(SHUFFLE_PARTS),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own setting, else (local runs only) a new one."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="patronage-checkpoint-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return configured or context.getCheckpointDir()


def _bytes(size: str) -> int:
    """Bytes of a size as Spark's settings write it: 64MB, 8m, 1048576b, 1048576."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << 10 * "bkmgtp".index((unit or "b")[0])


@contextmanager
def small_parts(spark: SparkSession, most: int = MERGED_BYTES) -> Iterator[None]:
    """Jobs run inside merge shuffle parts to ``most`` bytes, or to the session's own size if that is less.

    With larger parts a task sorts and groups more rows at once as the input grows, up to the point where it spills.
    """
    before = spark.conf.get(MERGE_TO)
    if _bytes(before) <= most:
        yield
        return
    spark.conf.set(MERGE_TO, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(MERGE_TO, before)


def pin(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the shared checkpoint folder and read it from there.

    Used where a later step must see exactly the same rows again (range partition numbers) or where
    several steps share one expensive input. The files outlive a lost executor, and as they are
    columnar a later step reads only the columns it needs. Shuffle parts are kept small meanwhile.
    """
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{folder}/patronage-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with small_parts(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

