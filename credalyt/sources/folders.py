"""Where queries and operators may write: the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Folders of local sessions that name none, by application; and the paths handed out.
_own: dict[str, str] = {}
_handed_out: dict[str, tuple[str, SparkSession]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session names it; only a local session without one gets its own."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="credalyt-")
            _handed_out[_own[app]] = (app, spark)
        named = _own[app]
    return named.rstrip("/")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder.  Tables below it stay until ``release``, at the latest until the driver's Python ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _handed_out[path] = (spark.sparkContext.applicationId, spark)
    return path


def saved(df: DataFrame, path: str, options: dict | None = None) -> DataFrame:
    """``df`` as a table at ``path``: what is read later does not run again."""
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark._sc._jsc is None else spark._sc._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession | None = None) -> None:
    """Removes what was written for results that nobody reads any more (of one application, or of all)."""
    app = spark and spark.sparkContext.applicationId
    for path, (owner, its) in list(_handed_out.items()):
        if app is None or owner == app:
            remove(its, path)
            del _handed_out[path]
    for name in [a for a, path in _own.items() if path not in _handed_out]:
        del _own[name]


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except (Py4JError, OSError):  # the JVM has gone: nothing can be removed through it
        pass


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; other errors are raised."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def availability(spark: SparkSession, paths: dict[str, str]):
    """(source, available) of named sources."""
    rows = [(name, exists(spark, path)) for name, path in sorted(paths.items())]
    return spark.createDataFrame(rows, "source string, available boolean").orderBy(F.col("source"))
