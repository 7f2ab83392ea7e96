"""Change detection as keyed state: a stream of what enumerations see, and a state for each source.

A state holds the fingerprint of the last good content, whether it was validated, and the last runs in which the source was
seen and was protected by a warning. A source that a run doesn't see has no row in it; that it is gone shows when a run that
saw everything closes. So the event time is the number of runs that have closed: rows of a run stand a little after the last
closed one, and the row that closes a run is its time. Each state waits for the next close by a timer, and is told then
which run that was. Rows of one source may come in any order within a batch, and batches of a run in any order before its
close; a restart goes on from the checkpoint. A close takes effect with the next batch, as watermarks do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What an enumeration tells: kind is seen (with the fingerprint, and whether the content was valid; null if it wasn't read),
#: protected (a warning names the source), or closed (with no source: the run saw everything). closed: the last run before it that closed, 0 if none.
EVENTS = "source_id string, run bigint, closed bigint, kind string, fingerprint string, valid boolean"
#: What comes out: op is new, changed, unchanged or removed; the state after it; whether new content was invalid and the last good one stays.
CHANGES = "source_id string, run bigint, op string, fingerprint string, validated boolean, retained boolean"
STATE = "fingerprint string, validated boolean, seen bigint, protected bigint"

#: Seconds of event time from one run to the next, from a close to the rows after it, and of the watermark's delay, by which rows of one run never make each other late.
RUN, AFTER, DELAY = 1000, 500, 400
#: Over how many places sources are dealt; a place is what one call of Python works on, and never needs more than its own states.
PLACES = 1024


def close_time(run: int) -> int:
    """The millisecond at which a run closes."""
    return run * RUN * 1000


class Changes(StatefulProcessor):
    """Changes of a place's sources from run to run, a state for each; timers are the place's, and find what a close leaves behind."""

    def init(self, handle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", "source_id string", STATE)

    def _wait(self, closed: int) -> None:
        """Wakes the place when a run after `closed` closes; other times that it waits for stay."""
        self.handle.registerTimer(close_time(closed) + (AFTER + 1) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, waits = [], set()
        every = pd.concat(list(rows))
        every = every[every["kind"] != "closed"].sort_values(["source_id", "run", "kind"])
        names = [every[c].tolist() for c in ("source_id", "run", "closed", "kind", "fingerprint", "valid")]
        for source, of_source in groupby(zip(*names, strict=True), key=itemgetter(0)):
            held = self.states.getValue((source,))
            print_, validated, seen, protected = held if held is not None else (None, None, 0, 0)
            last = 0
            for _, run, closed, kind, fingerprint, valid in of_source:
                last = max(last, closed)
                if max(seen, protected) < closed:  # a run has closed without it; its timer would come after these rows
                    out += [(source, closed, "removed", print_, validated, False)] if print_ is not None else []
                    print_, validated, seen, protected = None, None, 0, 0
                if kind == "protected":
                    protected = max(protected, run)
                    continue
                if run <= seen:  # told before
                    continue
                seen = run
                valid = None if pd.isna(valid) else bool(valid)
                op = "new" if print_ is None else "unchanged" if fingerprint == print_ and validated else "changed"
                retained = op == "changed" and valid is False
                if op == "unchanged" or valid or (valid is not None and print_ is None):
                    print_, validated = fingerprint, op == "unchanged" or valid
                out.append((source, run, op, print_, validated, retained))
            # a source that has never been read has no state to lose
            if print_ is not None or protected:
                self.states.updateValue((source,), (print_, validated, seen, protected))
                waits.add(last)
            elif held is not None:
                self.states.removeKey((source,))
        for closed in waits:
            self._wait(closed)
        yield _told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = timerValues.getCurrentWatermarkInMs() // close_time(1)
        out, stay = [], False
        for (source,), (print_, validated, seen, protected) in list(self.states.iterator()):
            if max(seen, protected) >= run:
                stay = True
                continue
            self.states.removeKey((source,))
            out += [(source, run, "removed", print_, validated, False)] if print_ is not None else []
        if stay:
            self._wait(run)
        yield _told(out)

    def close(self) -> None:
        pass


def _told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source_id", "run", "op", "fingerprint", "validated", "retained"]).astype({"validated": "boolean"})


def changes(events: DataFrame) -> DataFrame:
    """CHANGES of a stream of EVENTS. The session's state store must be the one that keeps states apart: stateful_session()."""
    second = F.when(F.col("kind") == "closed", F.col("run") * RUN + DELAY).otherwise(F.col("closed") * RUN + AFTER)
    rows = events.withColumn("at", F.timestamp_seconds(second)).withWatermark("at", f"{DELAY} seconds")
    # sources are dealt over places, so that a call of Python serves many of them
    rows = rows.withColumn("place", F.pmod(F.xxhash64("source_id"), F.lit(PLACES)).cast("int"))
    told = rows.groupBy("place").transformWithStateInPandas(Changes(), CHANGES, "Append", "EventTime")
    return told.where("source_id <> ''")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their states in RocksDB, as states with timers need."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def change_stream(spark: SparkSession, incoming: str, out: str, checkpoint: str):
    """Follows a folder of EVENTS in Parquet files, writes CHANGES as Parquet, and ends; files that come later are taken by the next call."""
    own = stateful_session(spark)
    events = own.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(incoming).withColumn("source_id", F.coalesce("source_id", F.lit("")))
    return changes(events).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpoint_of(told: DataFrame) -> DataFrame:
    """(source_id, fingerprint, validated) after all changes that were told."""
    order = F.struct("run", F.when(F.col("op") == "removed", 1).otherwise(0))
    last = told.groupBy("source_id").agg(F.max_by(F.struct("op", "fingerprint", "validated"), order).alias("x")).select("source_id", "x.*")
    return last.where("op <> 'removed' and fingerprint is not null").drop("op")
