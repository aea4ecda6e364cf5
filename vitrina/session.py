"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join side measured to be small in every partition is hashed, others are sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # JSON-LD blocks may repeat a key; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Per-store top-k lists are pruned in the map tasks up to this many rows.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def build_session(app_name: str = "vitrina", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


# Of stored rows that are read several times. Not of `written_table`, whose size tells how many rows a block holds.
COMPRESSION = "zstd"

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once per application, so that they need not have it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="vitrina-ship-")) / "vitrina_package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
    return spark


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside may use tables as they are stored, by some of the join's columns only.

    For tables bucketed by product that are joined on more than the product. Not for joins in
    general: a side that was grouped by store would deal the other by store as well, and a large
    store would be one task's work.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="vitrina-")
    context.setCheckpointDir(made)
    return context.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def written_table(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, written now and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table under the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/vitrina/{app}/{name}-{uuid.uuid4().hex[:8]}"


def stored_bytes(stored: DataFrame) -> int:
    """Bytes of the files of a table that was read as it is stored."""
    plan = stored._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))
