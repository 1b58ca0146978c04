"""Guards around every turn of a conversation, as a table and as a stream.

Events of a conversation are results (numbers of a computation, its data and p-value), predictions for some data, and
turns (a message and the reply to it).  A turn is judged by what stands before it: its reply may only quote numbers of
results since the turn before; a message that asks for a test needs an earlier prediction for its data; and it is told how
many tests these data have had.  What a turn says alone is found in Spark's expressions before any state is asked.

Defined cases: a repeated event (same conversation and ``seq``) counts once; events of a null conversation are one
conversation in the table, and are left out of a stream; null texts say nothing; a null data_id needs no prediction.  On
a stream events wait until the watermark has passed their time, then count in order of ``seq``, which must rise with
time; events later than the watermark are dropped, with all others the stream's rows equal the table's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skerry.functions.columns import null_safe, running
from skerry.operators import guards

#: Words by which a message asks for a comparison.
ASKS_FOR_TEST = guards.phrase("test/tests/compare/compares/comparison/differ/differs/difference/significant/significance/bigger/smaller/better/worse/prove/proves/effect/effects")
MANY_TESTS = 3
TOLERANCE = 1e-6
_CLAIM = "array<struct<kind:string,number:double,places:int>>"
EVENT = "seq long, at timestamp, kind string, data_id string, numbers array<double>, p_value double"
TURN = "message string, said array<string>, asks boolean, claims " + _CLAIM
OUT = "conv_id string, seq long, message string, reasons array<string>, unverified int, tests_on_data long, notice boolean"


def prepared(events: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """What an event says by itself: the message without personal data, phrases of message and reply, numbers of the reply."""

    @F.pandas_udf(_CLAIM)
    def claimed(replies: pd.Series) -> pd.Series:
        return replies.map(lambda t: [{"kind": k, "number": n, "places": p} for _, _, k, n, p in guards.claims_of(t or "")])

    said = F.array_compact(F.array(F.when(F.size(guards.searching(F.col("message"))) > 0, "specification_search"), F.when(F.size(guards.blocked_claims(F.col("reply"))) > 0, "unsupported_claim")))
    return events.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"), "kind", "data_id", F.col("numbers").cast("array<double>").alias("numbers"), F.col("p_value").cast("double").alias("p_value"),
        guards.redact(F.col("message"), names).alias("message"), said.alias("said"), F.coalesce(guards.spoken(F.col("message")).rlike(ASKS_FOR_TEST), F.lit(False)).alias("asks"), claimed("reply").alias("claims"),
    )


def judged(events: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """A row a turn, from a table: the redacted message, the reasons to block it (none: it passes), how many numbers are unverified, tests so far."""
    rows = prepared(events, names).dropDuplicates(["conv_id", "seq"])
    tested = (F.col("kind") == "result") & F.col("p_value").isNotNull() & F.col("data_id").isNotNull()
    rows = running(rows, ["conv_id"], ["seq"], _turns=("sum", (F.col("kind") == "turn").cast("int")))
    rows = running(rows, ["conv_id", "data_id"], ["seq"], _tests=("sum", tested.cast("int")), _foretold=("sum", (F.col("kind") == "prediction").cast("int")))
    known = rows.where("kind = 'result'").groupBy(F.col("conv_id").alias("_c"), (F.col("_turns") + 1).alias("_t")).agg(F.flatten(F.collect_list(F.coalesce("numbers", F.array().cast("array<double>")))).alias("_known"))
    turns = rows.where("kind = 'turn'").join(known, null_safe([("conv_id", "_c"), ("_turns", "_t")]), "left")
    half = lambda c: F.lit(0.5) * F.pow(F.lit(10.0), -c["places"]) + TOLERANCE
    met = lambda c: F.exists("_known", lambda v: (F.abs(v - c["number"]) <= half(c)) | ((c["kind"] == "percentage") & (F.abs(v * 100 - c["number"]) <= half(c))))
    unverified = F.size(F.filter("claims", lambda c: ~F.coalesce(met(c), F.lit(False))))
    turns = turns.withColumn("unverified", unverified).withColumn("tests_on_data", F.when(F.col("data_id").isNull(), 0).otherwise(F.coalesce("_tests", F.lit(0))).cast("long"))
    unforeseen = F.col("asks") & F.col("data_id").isNotNull() & (F.coalesce("_foretold", F.lit(0)) == 0)
    late = F.array_compact(F.array(F.when(unforeseen, "no_prediction"), F.when(F.col("unverified") > 0, "unverified_number")))
    return turns.select("conv_id", "seq", "message", F.array_sort(F.concat("said", late)).alias("reasons"), "unverified", "tests_on_data", (F.col("tests_on_data") >= MANY_TESTS).alias("notice"))


class TurnGuard(StatefulProcessor):
    """A conversation's state: events that wait, the last event judged, numbers since the last turn, tests and predictions of its data."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", f"at_ms long, kind string, data_id string, numbers array<double>, p_value double, {TURN}")
        self.last = handle.getValueState("last", "seq long")
        self.known = handle.getValueState("known", "numbers array<double>")
        self.data = handle.getMapState("data", "data_id string", "tests long, predicted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if last is not None and r.seq <= last:
                    continue
                at = int(r.at.timestamp() * 1000)
                listed = lambda x: [] if x is None else list(x)
                p = None if pd.isna(r.p_value) else float(r.p_value)
                claims = [(c["kind"], float(c["number"]), int(c["places"])) for c in listed(r.claims)]
                self.waiting.updateValue((int(r.seq),), (at, r.kind, r.data_id, [float(x) for x in listed(r.numbers) if not pd.isna(x)], p, r.message, [str(x) for x in listed(r.said)], bool(r.asks), claims))
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        known = list(self.known.get()[0]) if self.known.exists() else []
        due = sorted((k[0], v) for k, v in self.waiting.iterator() if v[0] <= now)
        for seq, (_, kind, data_id, numbers, p, message, said, asks, claims) in due:
            tests, predicted = self.data.getValue((data_id,)) if data_id is not None and self.data.containsKey((data_id,)) else (0, False)
            if kind == "result":
                known.extend(numbers)
                tests += p is not None
            elif kind == "prediction":
                predicted = True
            elif kind == "turn":
                off = sum(not any(self._meets(c, v) for v in known) for c in claims)
                reasons = [*said, *(["no_prediction"] if asks and data_id is not None and not predicted else []), *(["unverified_number"] if off else [])]
                out.append((key[0], seq, message, sorted(reasons), off, tests if data_id is not None else 0, data_id is not None and tests >= MANY_TESTS))
                known = []
            if data_id is not None and kind in ("result", "prediction"):
                self.data.updateValue((data_id,), (tests, predicted))
            self.waiting.removeKey((seq,))
            self.last.update((seq,))
        self.known.update((known,))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    @staticmethod
    def _meets(claim, value: float) -> bool:
        kind, number, places = claim
        half = 0.5 * 10.0**-places + TOLERANCE
        return abs(value - number) <= half or (kind == "percentage" and abs(value * 100 - number) <= half)

    def close(self) -> None:
        pass


def judged_stream(events: DataFrame, names: tuple[str, ...] = (), late: str = "10 minutes") -> DataFrame:
    """``judged`` of a stream: a turn's row comes when the watermark has passed it.  Needs the RocksDB state store."""
    rows = prepared(events.withWatermark("at", late), names).where("conv_id is not null")
    return rows.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=TurnGuard(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
