"""Sessions as keyed streaming state: what a customer holds after each message, as messages arrive.

Parsing is a projection before the state. A session's state is the next turn, the texts and readings that it holds, and turns that came early and wait for those
before them, each a variable of its own, so a message reads and writes what it touches. A timer ends a session that has been silent: turns that wait are taken in without those
that never came, then all of it is removed. A session that has had its last turn keeps its next turn alone until the timer, so a message that comes twice starts no new session.
Keys are strings. The result is that of intent.tiered_constraints() on the whole table, as long as no session is silent for longer while it goes on.

The state store must be one that keeps variables and timers: RocksDB, which with_variables() sets for a session. Timers keep a query going without new messages; one that
is to end with the messages at hand (trigger availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off, and sees its timers with the next messages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harken.functions import text as tx
from harken.operators import dialogue as dlg
from harken.operators import intent

HELD = "sample_id string, turn int, part int, reading int, text string, attribute string, value string, tier string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds of silence after which a session is over.
SILENCE = 30 * 60 * 1000


def with_variables(spark: SparkSession) -> SparkSession:
    """The session, with the state store that variables and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def readings(messages: DataFrame) -> DataFrame:
    """(sample_id, turn, rows): every reading of a message (sample_id, turn, message) as a JSON array, in order; stateless, one row a message."""
    read = dlg.parsed(messages.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("turn").cast("int").alias("turn"), "message"))
    row = lambda part, text, at, p, tier: F.struct(part.alias("part"), at.alias("reading"), text.alias("text"), p["attribute"].alias("attribute"), p["value"].alias("value"), F.lit(tier).alias("tier"))
    told = F.flatten(F.transform("texts", lambda t, i: F.transform(tx.pairs(t), lambda p, j: row(i, t, j, p, "template"))))
    prose = F.regexp_replace(F.regexp_replace("message", intent.SCAFFOLD, " "), intent.LOOKING, " ")
    chunks = F.transform(F.split(prose, "[;.]"), lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    kept = lambda t: F.filter(F.transform(tx.pairs(t), lambda p, j: F.struct(p.alias("p"), j.alias("j"))), lambda x: (x["p"]["attribute"] != "feature") | (x["p"]["value"] != F.lower(t)))
    own = F.flatten(F.transform(chunks, lambda c, i: F.when(F.length(c) >= 3, F.transform(kept(c), lambda x: row(i, c, x["j"], x["p"], "ontology"))).otherwise(F.array().cast("array<struct<part:int,reading:int,text:string,attribute:string,value:string,tier:string>>"))))
    return read.select("sample_id", "turn", F.to_json(F.when(F.col("kind") == "other", own).otherwise(told)).alias("rows"))


class Sessions(StatefulProcessor):
    """Takes in a session's turns in their order and yields what each adds."""

    def __init__(self, silence: int = SILENCE):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "turn int")
        self.texts = handle.getMapState("texts", "text string", "turn int")
        self.pairs = handle.getMapState("pairs", "attribute string, value string", "turn int")
        self.early = handle.getMapState("early", "turn int", "rows string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        after = self.next.get()[0] if self.next.exists() else 1
        for r in rows:
            if r.turn >= after and not self.early.containsKey((r.turn,)):
                self.early.updateValue((r.turn,), (r.rows,))
        while after <= dlg.TURNS and self.early.containsKey((after,)):
            yield from self.taken(key[0], after, self.early.getValue((after,))[0])
            self.early.removeKey((after,))
            after += 1
        if after > dlg.TURNS:
            self.forget()
        self.next.update((after,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        for turn, rows in sorted((k[0], v[0]) for k, v in self.early.iterator()):
            yield from self.taken(key[0], turn, rows)
        self.forget()
        self.next.clear()

    def taken(self, session: str, turn: int, rows: str) -> Iterator[Row]:
        for r in json.loads(rows):
            pair, first = (r["attribute"], r["value"]), r["tier"] == "template" and r["reading"] == 0
            if not (self.texts.containsKey((r["text"],)) if first else self.pairs.containsKey(pair)):
                yield Row(sample_id=session, turn=turn, part=r["part"], reading=r["reading"], text=r["text"], attribute=pair[0], value=pair[1], tier=r["tier"])
                if first or r["tier"] == "ontology":
                    self.texts.updateValue((r["text"],), (turn,))
            self.pairs.updateValue(pair, (turn,))

    def forget(self) -> None:
        for held in (self.texts, self.pairs, self.early):
            held.clear()

    def close(self) -> None:
        pass


def held_constraints(messages: DataFrame, silence: int = SILENCE) -> DataFrame:
    """A stream of messages (sample_id, turn, message) to a stream of the constraints that they add. The query's output mode is append."""
    with_variables(messages.sparkSession)
    return readings(messages).groupBy("sample_id").transformWithState(Sessions(silence), HELD, "Append", "ProcessingTime")
