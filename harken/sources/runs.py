"""A sink for runs that are published once: each task writes a file of its own, and the commit names the files of one attempt under the run's id.

What is not named in a manifest does not count: files of tasks that failed or ran twice, of jobs that ended, of a run that was repeated. A repeated run finds its manifest and adds nothing.
Readers join files with manifests, so nothing but the few rows of manifests is listed. The folder must be one that the driver and all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


@dataclass
class Written(WriterCommitMessage):
    file: str
    n_rows: int


class RunWriter(DataSourceWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, base = folder(self.path)
        fs.create_dir(f"{base}/parts", recursive=True)
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with fs.open_output_stream(f"{base}/parts/{name}") as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(recursive=True), default=str) + "\n").encode())
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest under a name of its own, then moved to the run's: it is there as a whole or not at all."""
        fs, base = folder(self.path)
        final = f"{base}/runs/{self.run}.json"
        if fs.get_file_info(final).type != pafs.FileType.NotFound:
            self.abort(messages)
            return
        fs.create_dir(f"{base}/runs", recursive=True)
        said = json.dumps({"run": self.run, "files": [m.file for m in messages if m], "n_rows": sum(m.n_rows for m in messages if m)})
        draft = f"{base}/runs/_{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(said.encode())
        fs.move(draft, final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = folder(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{base}/parts/{m.file}")


class Runs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "harken_runs"

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        run = self.options.get("run", "")
        if overwrite or not run or not run.replace("-", "").replace("_", "").isalnum():
            raise ValueError("runs are appended, under an id of letters, digits, - and _")
        return RunWriter(self.options["path"], run)


def write_run(df: DataFrame, path: str, run: str) -> None:
    """Adds the rows of a run, unless the run is there."""
    df.sparkSession.dataSource.register(Runs)
    df.write.format("harken_runs").option("path", path).option("run", run).mode("append").save()


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All published rows, with the run of each. ``schema`` is that of the rows."""
    manifests = spark.read.schema("run string, files array<string>, n_rows long").json(f"{path}/runs")
    files = manifests.select("run", F.explode("files").alias("_file"))
    rows = spark.read.schema(schema).json(f"{path}/parts").select("*", F.col("_metadata.file_name").alias("_file"))
    return rows.join(files, "_file").drop("_file")
