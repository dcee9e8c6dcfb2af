"""The optional model tier around an injected transport: distinct requests, a content-addressed cache, retries, and answers read strictly.

Without a transport the tier is offline: cached answers only, and nothing for the rest. No network code is here.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harken.operators.experiments import nearest_rank
from harken.sources.registry import trials_at
from harken.sources.stages import staged

Transport = Callable[[str, dict], dict]
RETRIES, AGAIN = 3, (429, 500, 502, 503)
ANSWER = "key string, answer string, prompt_tokens long, completion_tokens long, seconds double, failed boolean"
OPERATIONS = "array<struct<op:string,attribute:string,value:string,evidence:string,polarity:string,strength:string,confidence:double,group:string>>"
RESTORED = f"route string, normalized_text string, kind string, category string, attribute string, operations {OPERATIONS}"


class Refused(Exception):
    """What a transport raises for an answer with a status."""

    def __init__(self, status: int):
        super().__init__(status)
        self.status = status


def request_key(path: Column, body: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, body), 256), 1, 32)


def _asked(transport: Transport, path: str, body: str, wait: float) -> dict | None:
    for attempt in range(RETRIES):
        try:
            return transport(path, json.loads(body))
        except Refused as e:
            if e.status not in AGAIN or attempt + 1 == RETRIES:
                return None
            time.sleep(wait * 2**attempt)
        except Exception:  # noqa: BLE001 - a transport may raise anything; the request then has no answer
            return None
    return None


def answered(requests: DataFrame, cache: str, transport: Transport | None = None, wait: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(requests with key and answer, the calls made now). ``requests``: path, body (JSON with sorted keys).

    Each distinct request that the cache lacks is sent once; answers are appended to the cache, failures are not.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("key", request_key(F.col("path"), F.col("body")))
    known = trials_at(spark, cache)
    lacking = keyed.select("key", "path", "body").dropDuplicates(["key"])
    if known is not None:
        lacking = lacking.join(known.select("key"), "key", "left_anti")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, path, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                began = time.time()
                got = _asked(transport, path, body, wait) or {}
                text = ((got.get("choices") or [{}])[0].get("message") or {}).get("content") if "choices" in got else json.dumps(got["data"]) if "data" in got else None
                usage = got.get("usage") or {}
                said = (text or "").strip() or None
                rows.append({"key": key, "answer": said, "prompt_tokens": int(usage.get("prompt_tokens") or 0), "completion_tokens": int(usage.get("completion_tokens") or 0), "seconds": time.time() - began, "failed": said is None})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("answer", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("seconds", pa.float64()), ("failed", pa.bool_())]))

    none = spark.createDataFrame([], ANSWER)
    calls = none if transport is None else staged(lacking.mapInArrow(send, ANSWER), "model-calls")  # sent once, whatever is read later
    good = calls.where("not failed")
    if transport is not None:
        good.write.mode("append").parquet(cache)
    table = good if known is None else known.unionByName(good)
    return keyed.join(table.select("key", "answer").dropDuplicates(["key"]), "key", "left"), calls


def first_object(text: Column, schema: str) -> Column:
    """The first JSON object of free text, null where there is none or it is malformed."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def restored(answers: DataFrame) -> DataFrame:
    """Adds what an answer proposes: route, normalized_text, kind, category, attribute, operations."""
    df = answers.withColumn("_r", first_object(F.col("answer"), RESTORED))
    route = F.lower(F.trim("_r.route"))
    df = df.withColumn("route", F.when(route.isin("deterministic", "hybrid"), route).otherwise(""))
    text = F.substring(F.trim(F.coalesce("_r.normalized_text", F.lit(""))), 1, 1500)
    return df.select("*", text.alias("normalized_text"), "_r.kind", "_r.category", "_r.attribute", F.coalesce("_r.operations", F.array().cast(OPERATIONS)).alias("operations")).drop("_r")


def extracted(answers: DataFrame) -> DataFrame:
    """Adds pairs: (attribute, value) of an answer's constraints, lower case, both non-empty."""
    rows = first_object(F.col("answer"), "constraints array<struct<attribute:string,value:string>>")["constraints"]
    some = F.filter(F.coalesce(rows, F.array().cast("array<struct<attribute:string,value:string>>")), lambda r: (F.coalesce(r["attribute"], F.lit("")) != "") & (F.coalesce(r["value"], F.lit("")) != ""))
    return answers.withColumn("pairs", F.transform(some, lambda r: F.struct(F.lower(F.trim(r["attribute"])).alias("attribute"), F.lower(F.trim(r["value"])).alias("value"))))


def reranked(answers: DataFrame, candidates: str = "candidates") -> DataFrame:
    """Adds ranked: the candidates in the answer's order if it names each of them, else null."""
    order = F.from_json(F.nullif(F.regexp_extract("answer", r"\[[\d,\s]+\]", 0), F.lit("")), "array<int>")
    n = F.size(candidates)
    order = F.array_distinct(F.filter(order, lambda i: (i >= 1) & (i <= n)))
    return answers.withColumn("ranked", F.when(F.size(order) == n, F.transform(order, lambda i: F.get(F.col(candidates), i - 1))))


def vectors(answers: DataFrame) -> DataFrame:
    """Adds embedding: the vectors of an answer of the embeddings path."""
    rows = F.from_json("answer", "array<struct<embedding:array<float>>>")
    return answers.withColumn("vectors", rows["embedding"])


def read_template_or_prose(message: str, extract: Callable[[str], list[tuple[str, str]]]) -> list[tuple[str, str]]:
    """Pairs of a message by an aligned extractor, kept only where the value stands in the message."""
    return [(a, v) for a, v in extract(message) if re.search(re.escape(v), message, re.I)]


def report(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: calls, hits of the cache, failures, tokens, and the median and 95th latency by nearest rank."""
    sums = calls.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(F.col("failed").cast("long")), F.lit(0)).alias("failures"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))
    hits = requests.join(calls.select("key").distinct(), "key", "left_anti").where("answer is not null").agg(F.count(F.lit(1)).alias("cache_hits"))
    late = nearest_rank(calls.withColumn("_all", F.lit(1)), ["_all"], "seconds", {"latency_p50": 0.5, "latency_p95": 0.95}, 0.001).drop("_all")
    return sums.crossJoin(hits).join(late, F.lit(True), "left")  # a row each
