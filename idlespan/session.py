"""Session helpers: where shared intermediate tables go, and a local builder."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_SHIPPING = threading.Lock()


def local_session(name: str, cores: str = "8", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="idlespan-")


def _session_folder(spark: SparkSession, root: str) -> str:
    """One folder for all that a session stores; it goes when the session's driver ends."""
    context = spark.sparkContext
    folder = f"{root.rstrip('/')}/idlespan-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared folder the cluster names.

    ``spark.checkpoint.dir`` must name storage every executor can reach.  Only a
    local session may go without it; it then gets a temporary folder.  All folders
    of a session are removed when its driver ends.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
        root = _local_root()
    return f"{_session_folder(spark, root)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: runs a job, cuts lineage.

    For tables read many times (model training).  Being a written table it
    survives lost executors, unlike a cached one.
    """
    path = shared_folder(df.sparkSession) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Hand this package's code to the executors, which need not have it installed; once a session."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    with _SHIPPING:
        if getattr(context, "_has_package", None) == package.name:
            return
        archive = Path(tempfile.mkdtemp(prefix=f"{package.name}-code-"), f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._has_package = package.name
