"""Session settings and the few helpers that must look at the session.

The library itself only builds DataFrames. Three things need more than that:
a place to write intermediate tables, a size check before a broadcast, and a
session with the settings the library was tuned for.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side must have at most this many rows (rows here are short: a
# term and a weight, a key and a timestamp, one query vector).
BROADCAST_ROWS = 200_000
# Rows of one key from which on a salted join splits it.
HEAVY_ROWS = 1_000_000
_shipped: set[str] = set()
_fallback: dict[str, str] = {}  # temporary folder of a local application
_staged: list[str] = []

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Keyed state (conversations, sessions) lives in RocksDB, not on the heap.
    _STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "threadmine", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` keys use ``__`` for a dot."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """What is run in here has these settings of the session, which then gets its own back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def typed_state(spark: SparkSession):
    """Streaming queries started in here keep their state in RocksDB, whatever the session is set to.

    Typed state needs it. A query copies the settings of its session when it starts, so the session gets its own back.
    """
    return settings(spark, {_STATE_STORE: DEFAULTS[_STATE_STORE]})


def shuffles_removed(spark: SparkSession):
    """What is run in here leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; their tasks import its modules."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "threadmine.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session, where driver and executors are one machine, may fall
    back to a temporary folder; on a cluster the setting has to be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _fallback:
        _fallback[application] = tempfile.mkdtemp(prefix="threadmine-")
    return _fallback[application]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors and, unlike a checkpoint,
    keeps column pruning and filter pushdown for what is read from it. ``codec``: compression other than the session's.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, compression=codec)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> int:
    """How many tables were staged so far: a mark for ``discard_staged``."""
    return len(_staged)


def discard_staged(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Delete the tables staged after the mark ``since``, but for those that ``keep`` reads.

    Call it when everything that was built on them has been written.
    """
    held = {path.rstrip("/") for f in (keep.inputFiles() if keep is not None else []) for path in _staged if f"/{path.rsplit('/', 1)[1]}/" in f}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _staged[since:]:
        if path not in held:
            at = hadoop(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _staged[since:] = [path for path in _staged[since:] if path in held]


def is_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    rows_per_salt: int = HEAVY_ROWS,
) -> DataFrame:
    """Equi-join where one key of ``big`` may hold a large part of its rows.

    The rows of each key of ``big`` are counted first. A key with more than ``rows_per_salt`` is spread by
    the hash of ``spread_by`` over as many parts as it has that many rows, and only its rows of
    ``small`` are repeated; all other keys are joined as they are. There are at most
    ``rows / rows_per_salt`` heavy keys, so their table can be broadcast.
    """
    heavy = F.broadcast(big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_salt).select(
        *on, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts")))
    parts = F.coalesce("_salts", F.lit(1))
    left = big.join(heavy, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), parts).cast("int")).drop("_salts")
    right = small.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    bounded: bool | None = None,
) -> DataFrame:
    """Broadcast ``small`` if its size was checked, else fall back to the salted join.

    Pass ``bounded`` when the caller has already checked a table that ``small``
    cannot outgrow; that saves running ``small`` once more just to count it.
    """
    if bounded is None:
        bounded = is_bounded(small, max_rows)
    if bounded:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, spread_by, how)
