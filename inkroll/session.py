"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "inkroll", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings the engine expects; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session, whose executors are its own threads, may go without: it gets a temporary folder. Elsewhere that
    would be a folder of one machine, so an error is raised.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = os.path.join(tempfile.gettempdir(), "inkroll-checkpoints")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


_tables: dict[str, SparkSession] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which `clear` deletes."""
    path = f"{shared_folder(spark)}/inkroll-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which survives the loss of executors.

    A compressed columnar table is several times smaller than a checkpoint of rows and later reads prune
    its columns. `release` deletes it when nothing will read it any more, `clear` all such tables; those left
    are deleted when the Python process ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._inkroll_table = path
    return made


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames that `materialise` returned; other frames are left alone."""
    for frame in frames:
        _delete(getattr(frame, "_inkroll_table", None))


@atexit.register
def clear() -> None:
    """Delete all tables made so far: for when the results have been read or written."""
    for path in list(_tables):
        _delete(path)


def _delete(path: str | None) -> None:
    spark = _tables.pop(path, None)
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is temporary anyway
        pass


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows over all cores if the scan has too few splits for them.

    A single-row-group file is read by one task however many splits it has. Inputs with plenty of
    splits pass unchanged, so at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() * 2 < cores else df


def ship_package(spark: SparkSession) -> None:
    """Add the package to the Python path of the executors once per session, as a zip file."""
    import shutil
    from pathlib import Path

    import inkroll

    context = spark.sparkContext
    if getattr(context, "_inkroll_shipped", False) or context.master.startswith("local["):
        return
    root = Path(inkroll.__file__).parent
    folder = tempfile.mkdtemp()  # on the driver; Spark copies the file to every executor
    stage = Path(folder) / "stage"
    shutil.copytree(root, stage / "inkroll", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder) / "inkroll_package"), "zip", stage))
    context._inkroll_shipped = True
