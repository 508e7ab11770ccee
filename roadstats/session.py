"""Spark session helpers.

The library never creates its own session inside an operator; callers pass
one in.  ``local_session`` is for tests, benches and scripts only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "roadstats") -> SparkSession:
    """A local-mode session tuned for small test scales (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ROADSTATS_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # local runs only: a stable scratch folder as the shared folder, so
        # generated stand-in files are reused between runs
        .config("spark.checkpoint.dir",
                os.environ.get("ROADSTATS_CHECKPOINT_DIR", "/tmp/roadstats-scratch"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Reads ``spark.checkpoint.dir`` from the session (or an already-set
    SparkContext checkpoint dir).  Only when nothing is configured on a local
    master (tests) a fresh scratch folder is created and registered; on a
    cluster that is an error, as executors share no local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="roadstats-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_dir(spark: SparkSession) -> str:
    """The shared folder itself (``spark.checkpoint.dir``), without the
    per-application sub-folder SparkContext adds for RDD checkpoints; used
    for tables that later sessions reuse (e.g. generated stand-in files)."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    ckpt = checkpoint_dir(spark).rstrip("/")
    return ckpt.rsplit("/", 1)[0]


def reliable_checkpoint(df):
    """``df.checkpoint(eager=True)`` without computing ``df`` twice.

    Writing a reliable checkpoint runs a second job over the same RDD; with
    the rows persisted (memory, spilling to disk) for the duration, that job
    reads them instead of recomputing the whole lineage.  The result reads
    from the checkpoint folder only (lineage cut), so the persisted copy is
    released afterwards and a lost executor costs nothing.
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def session_with(spark: SparkSession, settings: dict[str, object]) -> SparkSession:
    """A session with ``spark``'s settings but for ``settings``, for reads that need others than the rest of a query."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    for k, v in settings.items():
        own.conf.set(k, v)
    return own


def small_files_session(spark: SparkSession) -> SparkSession:
    """A session with ``spark``'s settings for reading folders of very many small files.

    Spark lists up to 10000 folders a job in a task each and counts a file as 4 MB when it
    packs files into tasks: for a file of a few lines the tasks then cost more than the
    reading.  Here a listing job has a few tasks a core, and a task reads thousands of files.
    """
    return session_with(spark, {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * spark.sparkContext.defaultParallelism,
        "spark.sql.files.openCostInBytes": "64k"})


#: Bytes of input for each partition that a shuffle begins with, and the most partitions that input alone asks for.
PARTITION_INPUT, MOST_PARTITIONS = 2 << 20, 20_000


def shuffle_partitions(spark: SparkSession, *inputs: str) -> int:
    """Partitions of a shuffle of ``inputs``: as many as are set, more if the files hold more than they can take.

    A count that is set and stays makes every task of a shuffle grow with the input; Spark merges what is too many."""
    size = 0
    for name in inputs:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PARTITION_INPUT), MOST_PARTITIONS))


def light_tasks_session(spark: SparkSession, *inputs: str) -> SparkSession:
    """A session for jobs that sort wide rows: a task reads 32 MB and gets 16 MB after a shuffle, as 64 MB of packed rows
    are some 400 MB in a sort, which four of them on an executor spill.  Shuffles begin with partitions by the size of
    the files ``inputs`` (see ``shuffle_partitions``)."""
    return session_with(spark, {"spark.sql.files.maxPartitionBytes": "32m",
                                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
                                "spark.sql.shuffle.partitions": shuffle_partitions(spark, *inputs)})


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Workers that run Python functions of the package must be able to import
    it, wherever the driver was started.  The zip is written to the shared
    folder and handed to ``addPyFile``.
    """
    import hashlib
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from a shipped zip
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(f.relative_to(root.parent))), f.read_bytes())
    data = held.getvalue()
    name = f"{shared_dir(spark)}/code-{hashlib.sha1(data).hexdigest()[:12]}-{sc.applicationId}/{root.name}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    sc.addPyFile(name)
    _SHIPPED[sc.applicationId] = name


def scale_tag(sf_dir: str) -> str:
    """Folder-safe name for data derived from ``sf_dir``: its base name plus
    a short hash of the full path (two scales with the same base name in
    different places do not share derived files)."""
    import hashlib
    import re
    path = sf_dir.rstrip("/")
    base = re.sub(r"[^A-Za-z0-9_.-]", "_", path.split("/")[-1])
    return f"{base}-{hashlib.sha1(path.encode()).hexdigest()[:8]}"
