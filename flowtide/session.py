"""Session factory and the durable scratch area that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: The scope that frames are stored in, if any, and earlier ones that aren't removed yet.
_SCOPE: list[str] = []
_PAST: list[str] = []

# Defaults for a session this package builds itself. On a cluster the submitter's
# settings win: nothing here is forced onto an existing session.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "flowtide", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with UTC time, AQE and the RocksDB state store."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Event times are UTC everywhere; pin the session zone so NTZ casts are exact."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for local masters."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder every executor can reach")
    known = getattr(checkpoint_root, "_local", None)
    if known is None:
        known = checkpoint_root._local = tempfile.mkdtemp(prefix="flowtide-")
    return known


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the checkpoint folder."""
    app = spark.sparkContext.applicationId
    return "/".join([checkpoint_root(spark), "flowtide", app, *_SCOPE, f"{label}-{uuid.uuid4().hex}"])


def next_scope(spark: SparkSession, docs: DataFrame | None = None, opened: bool = True) -> None:
    """Store what follows in a scope of its own, and remove the frames of earlier scopes that ``docs`` doesn't read.

    For jobs of several steps in one thread, each of which writes its result before the next begins.
    """
    _PAST.extend(_SCOPE)
    _SCOPE[:] = [f"scope-{uuid.uuid4().hex}"] if opened else []
    read = " ".join(docs.inputFiles()) if docs is not None and _PAST else ""
    for scope in [s for s in _PAST if s not in read]:
        remove_folder(spark, f"{checkpoint_root(spark)}/flowtide/{spark.sparkContext.applicationId}/{scope}")
        _PAST.remove(scope)


def remove_folder(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Survives executor loss, freezes non-deterministic columns such as the partition id,
    and stays columnar so later branches prune what they do not need.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> bool:
    """Remove this application's stored frames. Call it once no frame built on them is needed."""
    return remove_folder(spark, f"{checkpoint_root(spark)}/flowtide/{spark.sparkContext.applicationId}")
