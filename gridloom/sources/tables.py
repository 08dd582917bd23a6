"""Reading the tables of a data folder, and the shared working folder of a session."""

from __future__ import annotations

import atexit
import tempfile
from contextlib import suppress
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` as a lazy DataFrame."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The cluster names its shared folder in ``spark.checkpoint.dir``; a folder of our own is set only where none is named and the
    session runs in one process (tests).
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


#: Folders made by this process, which nothing reads once it ends.
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that all executors share (``spark.checkpoint.dir``); a temporary one only in a single process. It is removed when this process ends, or by ``removed``."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"{named.rstrip('/')}/gridloom-{uuid4().hex}" if named else tempfile.mkdtemp(prefix="gridloom-")
    if not _MADE:
        atexit.register(_end)
    _MADE.append(folder)
    return folder


def removed(spark: SparkSession, *folders: str) -> None:
    """Delete folders, by default all that this process made; what was read from them can't be computed again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders or list(_MADE):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        if folder in _MADE:
            _MADE.remove(folder)


def _end() -> None:
    """At the end of the process: while the session still runs it deletes the folders."""
    with suppress(Exception):
        spark = SparkSession.getActiveSession()
        if spark is not None:
            removed(spark)
    import shutil

    for folder in _MADE:
        shutil.rmtree(folder.removeprefix("file:"), ignore_errors=True)


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once: written as Parquet into the shared folder and read back, with its size known to the optimizer. For large intermediate tables, as a checkpoint isn't compressed."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def epoch_millis(t: Column) -> Column:
    """Epoch milliseconds of a timestamp without zone, read as UTC whatever the session's zone; finer digits are cut off (floor)."""
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.date_part(F.lit("SECOND"), t).cast("decimal(10,6)")
    return days * 86_400_000 + F.hour(t).cast("long") * 3_600_000 + F.minute(t).cast("long") * 60_000 + F.floor(seconds * 1000).cast("long")
