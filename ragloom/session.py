"""Session construction and cluster-wide settings."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC for reproducible date arithmetic, AQE for
# runtime coalescing and skew-join splitting, Arrow for the few Python stages.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, app_name: str = "ragloom",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in DEFAULT_CONF.items():
        if k == "spark.sql.session.timeZone" or spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the executors' Python workers, once per application: where it is
    neither installed nor on a path that they are given, it is sent to them as a zip of compiled modules."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    given = [os.environ.get("PYTHONPATH", ""), sc.getConf().get("spark.executorEnv.PYTHONPATH", "")]
    given = [p for g in given for p in g.split(os.pathsep) if p]
    if sc.master.startswith("local"):
        given.append(os.getcwd())  # the workers are started in the driver's folder
    installed = os.path.basename(root) in ("site-packages", "dist-packages")
    if not installed and root not in [os.path.abspath(p) for p in given]:
        # read by the driver's own file server, which hands it to the executors
        path = os.path.join(tempfile.mkdtemp(prefix="ragloom-"), "ragloom.zip")
        with zipfile.PyZipFile(path, "w") as z:
            z.writepy(package)
        sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` from the session's configuration, or a checkpoint folder
    already set on the context. Only a local-mode session (tests) may fall back to a fresh
    temporary folder; a cluster must name a shared location, because executors can be lost and
    a machine-local folder would not survive that.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on this cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ragloom-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint root for a written intermediate table."""
    import uuid

    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def ensure_parallelism(df, min_partitions: int | None = None):
    """Give a CPU-heavy stage at least one task per core.

    A scan of a few large single-row-group files yields one task per file; on a cluster
    reading thousands of files this is a no-op, on small inputs it spreads the rows
    round-robin so the per-row work (regexes, hashing, matrix products) runs in parallel.
    """
    if df.isStreaming:
        return df  # micro-batches are planned per trigger
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    # from file names and the planner's size estimate alone: no job runs
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if len(df.inputFiles()) >= target or size >= target * split:
        return df
    return df.repartition(target)


def size_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 << 20,
                   max_partitions: int | None = None) -> int:
    """Size shuffles for an input of ``input_bytes``: the initial shuffle partition count is
    input / target (at least 3 per core, at most ``max_partitions`` if given); AQE then coalesces small
    partitions and splits skewed ones at run time. Returns the chosen count."""
    cores = spark.sparkContext.defaultParallelism
    n = int(max(input_bytes // max(target_partition_bytes, 1), cores * 3))
    n = min(n, max_partitions) if max_partitions else n
    for k, v in {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    }.items():
        spark.conf.set(k, v)
    return n
