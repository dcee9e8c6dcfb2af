"""What the operators of this folder share: table access, shared storage, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A character that is not ASCII white space.
SOLID = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where a local session has none (tests), a temporary folder stands in for it; on a cluster that is an error, as each machine would
    write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/harken-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: a cut in the lineage that outlives executors."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 2500, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once, whatever the texts' length: few rows, and few bytes where Spark can tell."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None)
        if now is not None and not 0 < int(now.rstrip("bB")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def strips(texts: list[str | None], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    out, lo, held = [], 0, 0
    for i, x in enumerate(texts):
        n = len(x or "")
        if held and held + n > most:
            out.append((lo, i))
            lo, held = i, 0
        held += n
    return [*out, (lo, len(texts))] if len(texts) > lo else out


def text_of(col: str | Column) -> Column:
    """The text as a string, null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def nested(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one struct, so that no helper column can clash with one of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def restore(df: DataFrame, docs: DataFrame, row: str, extra: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` out of the struct ``row``, then ``extra``, which replaces columns of the same name."""
    names = {k.lower() for k in extra}
    kept = [F.col(row).getField(c).alias(c) for c in docs.columns if c.lower() not in names]
    return df.select(*kept, *[v.alias(k) for k, v in extra.items()])


def sealed(df: DataFrame, keep: str, name: str, value: Column) -> DataFrame:
    """``keep`` and ``value`` as column ``name``, computed once per row.

    A filter on a computed column is moved below the projections that compute it, with their expressions inlined, each as often as it
    is named; nested array expressions grow out of hand there. No filter moves below a generator, so a generator of one row stops that.
    """
    return df.select(keep, F.explode_outer(F.array(value)).alias(name))
