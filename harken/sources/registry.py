"""What surrounds a run: named sets of sessions, settings, integrity of guarded files, trials, and the runs' register."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harken.sources.views import SESSIONS, read_jsonl

# Scores that others published, for reports.
REFERENCE_SCORES = {"popularity and category": 0.71334, "paraphrase-proof floor": 0.826, "theoretical maximum": 0.9922}


@dataclass(frozen=True)
class SessionSets:
    """Named sets of sessions under a folder. Fitting sees the training set alone; the others are for reports."""

    folder: str
    fit: str = "template/train.jsonl"
    reports: dict[str, str] = field(default_factory=lambda: {"public": "public.jsonl", "template_test": "template/test.jsonl", "freeform_test": "freeform/test.jsonl"})

    def fitting(self, spark: SparkSession, limit: int | None = None) -> DataFrame:
        self.guard(self.fit)
        df = read_jsonl(spark, f"{self.folder}/{self.fit}", SESSIONS)
        return df if limit is None else df.limit(limit)

    def report(self, spark: SparkSession, which: str) -> DataFrame:
        if which not in self.reports:
            raise KeyError(f"{which} is no set for reports: {sorted(self.reports)}")
        return read_jsonl(spark, f"{self.folder}/{self.reports[which]}", SESSIONS)

    def split(self, spark: SparkSession, corpus: str, name: str) -> DataFrame:
        if corpus not in ("freeform", "template") or name not in ("train", "validation", "test"):
            raise KeyError(f"no split {name} of {corpus}")
        return read_jsonl(spark, f"{self.folder}/{corpus}/{name}.jsonl", SESSIONS)

    def guard(self, path: str) -> None:
        """Refuses a set for reports where something is fitted."""
        if any(path.endswith(p) for p in self.reports.values()):
            raise PermissionError(f"{path} is for reports only")


@dataclass
class Settings:
    """Every setting of the engine with its value; the values are those that results were published with."""

    exact: bool = True
    attribute: bool = True
    lexical: bool = True
    exact_gain: float = 3.2
    soft_card_gain: float = 1.5
    soft_card_floor: float = 0.34
    bm25_gain: float = 0.0
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    temperature: float = 2.0
    tau_mass: float = 0.85
    erase: str = "demote"
    exclude_shipped: bool = True
    v_continue: float = 0.75
    turn_cost: float = 0.0667
    stall_decay: float = 0.2
    stall_decay_clean: float = 0.8
    deadline: int = 3
    max_turns: int = 10

    @classmethod
    def parsed(cls, said: str | None) -> Settings:
        """From ``no_exact,bm25_gain=2.0,lexical``: no_x turns off, x turns on, x=v sets; truth values are read as such, unknown names refused."""
        out, known = cls(), {f.name: f.type for f in fields(cls)}
        for token in filter(None, (t.strip() for t in (said or "").split(","))):
            name, equals, value = token.partition("=")
            if not equals and name not in known and name.removeprefix("no_") in known:
                name, value = name.removeprefix("no_"), False
            elif not equals:
                value = True
            if name not in known:
                raise KeyError(f"unknown setting {name}")
            if isinstance(value, str):
                kind = known[name]
                value = {"true": True, "1": True, "false": False, "0": False}[value.lower()] if kind == "bool" else {"float": float, "int": int, "str": str}[kind](value)
            setattr(out, name, value)
        return out


def read_env(path: str) -> dict[str, str]:
    """Lines KEY=VALUE of a file, without comments; an environment that has the key keeps its own."""
    found = {}
    for line in Path(path).read_text().splitlines() if os.path.exists(path) else []:
        key, equals, value = line.strip().partition("=")
        if equals and not key.startswith("#"):
            found[key.strip()] = os.environ.get(key.strip(), value.strip())
    return found


def manifest(root: str, names: list[str]) -> dict[str, str]:
    """SHA-256 of files; a missing one is an error, not a gap."""
    return {name: hashlib.sha256((Path(root) / name).read_bytes()).hexdigest() for name in names}


def verify(root: str, expected: dict[str, str]) -> None:
    """Raises if a guarded file changed or is gone."""
    drift = [n for n, h in expected.items() if not (Path(root) / n).exists() or manifest(root, [n])[n] != h]
    if drift:
        raise RuntimeError(f"changed since the manifest was made: {sorted(drift)}")


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows whatever their order: the sum of the rows' hashes, and their number."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    n, total, other = df.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(k), *cols).cast("decimal(38,0)")) for k in (0, 1)]).first()
    return hashlib.sha256(f"{sorted(df.columns)}:{n}:{total}:{other}".encode()).hexdigest()


def summary(metrics: DataFrame) -> DataFrame:
    """The flat record of a run: overall figures beside the score of each scenario."""
    whole = metrics.where("scenario_type = 'all'").select("sample_count", "hit_rate", "mrr", "mttc", "efficiency", "score")
    parts = metrics.where("scenario_type <> 'all'").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scenario_type", "score")))).alias("scenario_scores"))
    return whole.crossJoin(parts)  # a row each


def add_trials(trials: DataFrame, path: str) -> None:
    """Appends finished trials (config, objective) to a study's table."""
    trials.write.mode("append").parquet(path)


def trials_at(spark: SparkSession, path: str) -> DataFrame | None:
    """A study's trials so far, to resume it; None for a new study."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None
