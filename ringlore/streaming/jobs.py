"""The incremental operators as Structured Streaming jobs.  State is bounded by watermarks or by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

LATENESS = "14 days"


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:  # noqa: ANN001
    """Events as files of ``path`` arrive; a watermark needs ``ts`` as an instant."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """STR08: counts and means of event-time windows; rows later than the watermark are dropped."""
    own = F.window("ts", length)
    return events.withWatermark("ts", lateness).groupBy(own, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def sliding(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes", lateness: str = LATENESS) -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """STR13."""
    return events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def first_only(events: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """STR01, STR07: the first row of each key within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def limiter(events: DataFrame, most: int = 3, seconds: int = 600) -> DataFrame:
    """STR09: each event with whether it is allowed: at most ``most`` allowed ones in the trailing seconds of a user.

    Refused events do not count.  State is a user's allowed times within the window, ``most`` at most, and it goes
    when the user has been silent for a window.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        for rows in batches:
            rows, allowed = rows.sort_values(["ts", "event_id"]), []
            for t in rows.ts.astype("int64") // 1_000_000:
                times = [x for x in times if x > t - seconds * 1_000]
                allowed.append(len(times) < most)
                if allowed[-1]:
                    times.append(int(t))
            yield pd.DataFrame({"event_id": rows.event_id, "user_id": key[0], "allowed": allowed})
        state.update((times,))
        # a time that has passed already would be refused
        state.setTimeoutTimestamp(max(max(times, default=0) + seconds * 1_000, state.getCurrentWatermarkMs() + 1))

    out, held = "event_id long, user_id long, allowed boolean", "times array<long>"
    stamped = events.withWatermark("ts", LATENESS).select("user_id", "event_id", "ts")
    return stamped.groupBy("user_id").applyInPandasWithState(decide, out, held, "append", "EventTimeTimeout")


def hidden(reports: DataFrame, least: int = 6) -> DataFrame:
    """STR12, without the rules on a reporter's age and posts that the batch form has: subjects with ``least`` distinct reporters or more; a reporter counts once per subject."""
    once = reports.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_type", "user_id"])
    return once.groupBy("event_type").agg(F.count("*").alias("reporters")).where(F.col("reporters") >= least)


def copied_posts(posts: DataFrame, hours: int = 24, lateness: str = LATENESS) -> DataFrame:
    """STR10: posts (``post_id``, ``user_id``, ``fp``, ``ts``) of which another user posted the same letters within the hours before.

    A join of the stream with itself over an interval, each side with a watermark, so state is what the interval and lateness hold.
    """
    a = posts.select(F.col("fp"), F.col("user_id").alias("first_user"), F.col("ts").alias("first_ts")).withWatermark("first_ts", lateness)
    b = posts.withWatermark("ts", lateness)
    within = F.expr(f"first_ts <= ts AND first_ts >= ts - INTERVAL {hours} HOURS")
    met = b.join(a, (b["fp"] == a["fp"]) & within & (F.col("user_id") != F.col("first_user")))
    return met.select("post_id", "user_id", "ts").dropDuplicatesWithinWatermark(["post_id"])


class Proposals(StatefulProcessor):
    """STR05 of one target: the pending proposal, and fingerprints that were rejected, each remembered until an event-time timer forgets it."""

    def __init__(self, days: int) -> None:
        self.memory_ms = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "fingerprint string")
        self.rejected = handle.getMapState("rejected", "fingerprint string", "until long")

    def _outcome(self, fingerprint: str | None, decision: str | None, at: int) -> str:
        held = self.pending.get()[0] if self.pending.exists() else None
        if decision:
            if held is None:
                return "nothing to decide"
            if decision == "rejected":
                self.rejected.updateValue((held,), (at + self.memory_ms,))
                self.handle.registerTimer(at + self.memory_ms)
            self.pending.clear()
            return "decided"
        if fingerprint is None:
            self.pending.clear()
            return "superseded" if held else "nothing to supersede"
        if held == fingerprint:
            return "unchanged"
        if held is None and self.rejected.containsKey((fingerprint,)) and self.rejected.getValue((fingerprint,))[0] > at:
            return "remembered"
        self.pending.update((fingerprint,))
        return "updated" if held else "added"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        every = pd.concat(rows).sort_values(["ts", "seq"])
        nothing = lambda x: None if pd.isna(x) else x
        told = [self._outcome(nothing(f), nothing(d), int(t.value // 1_000_000)) for f, d, t in zip(every.fingerprint, every.decision, every.ts)]
        yield pd.DataFrame({"target": key[0], "seq": every.seq.to_numpy(), "outcome": told})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        over = expiredTimerInfo.getExpiryTimeInMs()
        for fingerprint in [f for f, until in self.rejected.iterator() if until[0] <= over]:
            self.rejected.removeKey(fingerprint)
        return iter([])

    def close(self) -> None:
        pass


def proposals(found: DataFrame, days: int = 30, lateness: str = "1 day") -> DataFrame:
    """STR05: what becomes of each row of ``found`` (``target``, ``seq``, ``fingerprint``, ``decision``, ``ts``) in order of time: ``target``, ``seq``, ``outcome``.

    A row is a change that was found (``added``, ``updated``, ``unchanged``, or ``remembered`` where the same was rejected under ``days`` ago), a null
    fingerprint where a run no longer finds one (``superseded``), or a decision on what is pending.  Needs the RocksDB state store.
    """
    return found.withWatermark("ts", lateness).groupBy("target").transformWithStateInPandas(Proposals(days), "target string, seq long, outcome string", "Append", "EventTime")
