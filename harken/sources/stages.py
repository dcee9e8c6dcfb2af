"""Tables that a plan reads more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``.

    Where a local session has no such folder, a temporary one stands in for it; on a cluster that is an error, as each machine would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/harken-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under a fresh name in the shared folder, read back."""
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables kept for an application, by application, input folder and name.
_KEPT: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def kept(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of an input folder, made and staged at its first use in an application and read from there afterwards.

    For what every query of a folder needs, such as its index. The input is taken not to change while the application runs; a stage that is gone is made again.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key in _KEPT:
        path, schema = _KEPT[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            del _KEPT[key]
    df = make()
    path = staged_path(spark, name)
    df.write.parquet(path)
    _KEPT[key] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)
