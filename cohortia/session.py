"""Tables, shared work folders and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_cuts: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only a local master may go without that setting; it then gets a temporary folder, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="cohortia-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return f"file://{_local_dirs[app]}"


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder, deleted when the driver's program ends."""
    path = f"{shared_dir(spark)}/cohortia-{label}-{uuid.uuid4().hex}"
    if not _cuts:
        atexit.register(_drop_all)
    _cuts[path] = spark
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df once under the shared folder and go on from the written table.

    It cuts lineage like checkpoint(), computes df a single time and keeps the columns compressed;
    a lost executor costs nothing that was written.
    """
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop_all() -> None:
    """At the end of the driver's program nothing reads its cuts any more."""
    for path, spark in _cuts.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  (the session has ended: what lies in a file system of the driver can still go)
            if path.startswith("file:") or path.startswith("/"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cohortia-" not in folder:
            continue
        _delete(spark, folder)
