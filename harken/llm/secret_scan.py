"""Secret scans (operator 3): an incremental ledger of blobs.

Every version of every path is content-addressed by SHA-256. A ledger holds what each (blob, rule version) pair gave;
only pairs that it lacks are scanned, each once, whatever the number of paths and versions that hold the blob, and the
findings are joined back to all of them. The ledger is a table that grows by appending; its location is a parameter.

A blob's text crosses the network once per task that holds it at most: the choice of one text per blob is an
aggregate that Spark combines before the shuffle, so thousands of copies are no hot key. The join back moves ids and
findings, not texts, and is an ordinary equi-join whose skewed keys adaptive execution splits.

Edge cases: a null text counts as empty and has no findings; equal texts share one blob and get equal findings; a pair that is in the
ledger twice, as two runs at once can leave it, counts once; an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shared_path, text_of


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret: its pattern, the least length of one group, and words without which no text can match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()
    base: bool = False


#: The order is that of kinds at equal starts.
RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18, hints=("AKIA",), base=True),
    SecretRule("hex", r"[0-9a-f]{16,}", base=True),
    SecretRule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hints=("-----BEGIN ",)),
    SecretRule("signed_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyJ",)),
    SecretRule("prefixed_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", hints=("gh", "xox", "sk_live_")),
    SecretRule("url_password", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@", hints=("://",)),
)


@dataclass
class Scanner:
    """All rules compiled; picklable by its rules."""

    rules: tuple[SecretRule, ...] = RULES
    compiled: list[re.Pattern[str]] = field(init=False)

    def __post_init__(self) -> None:
        self.compiled = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in self.rules]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule's place, end), sorted."""
        out, lower = [], None
        for k, (rule, pattern) in enumerate(zip(self.rules, self.compiled, strict=True)):
            if rule.hints:
                if rule.any_case and lower is None:
                    lower = text.lower()
                if not any(h in (lower if rule.any_case else text) for h in rule.hints):
                    continue
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return sorted(out)


def rule_version(rules: tuple[SecretRule, ...] = RULES) -> str:
    """Changes whenever a rule does."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _scan(unseen: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(blob, text) to (blob, rule_version, counts map, spans, base_spans); blobs without findings too, for the ledger."""
    version = rule_version(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            blobs, counts, spans, base = [], [], [], []
            for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = scanner.spans(text)
                n = dict.fromkeys((rules[k].kind for _, k, _ in found), 0)
                for _, k, _ in found:
                    n[rules[k].kind] += 1
                blobs.append(blob)
                counts.append(list(n.items()))
                spans.append(",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in found))
                base.append(",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in found if rules[k].base))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.string()), pa.array([version] * len(blobs), pa.string()), pa.array(counts, pa.map_(pa.string(), pa.int64())), pa.array(spans, pa.string()), pa.array(base, pa.string())],
                ["blob", "rule_version", "counts", "spans", "base_spans"],
            )

    return unseen.select("blob", "text").mapInArrow(scan, "blob string, rule_version string, counts map<string,bigint>, spans string, base_spans string")


def ledger_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path, None if there is none yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path)


def secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, blob, counts by kind (map), spans, base_spans.

    ``ledger`` is a folder in shared storage, made if it is missing; None takes a fresh one.
    """
    spark, version = docs.sparkSession, rule_version(rules)
    bounded_batches(spark)
    ledger = ledger or shared_path(spark, "secret-ledger")
    paths = docs.select(F.col(id_col).alias("id"), F.sha2(F.encode(text_of(text_col), "UTF-8"), 256).alias("blob"))
    texts = docs.select(F.sha2(F.encode(text_of(text_col), "UTF-8"), 256).alias("blob"), text_of(text_col).alias("text"))
    seen = ledger_at(spark, ledger)
    if seen is not None:
        texts = texts.join(seen.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    _scan(texts.groupBy("blob").agg(F.first("text").alias("text")), rules).write.mode("append").parquet(ledger)
    known = spark.read.parquet(ledger).where((F.col("rule_version") == version) & (F.col("spans") != ""))
    known = known.select("blob", "counts", "spans", "base_spans").dropDuplicates(["blob"])  # two runs at once may both have scanned a blob
    out = paths.join(known, "blob", "left")
    nothing = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<bigint>))")
    return out.select(
        F.col("id").alias(id_col),
        "blob",
        F.coalesce("counts", nothing).alias("counts"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("base_spans", F.lit("")).alias("base_spans"),
    )
