"""Incremental jobs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelsift.operators.search import postings


def index_postings(stream: DataFrame, path: str, checkpoint: str):
    """Z-01: append the postings of new documents; a restart goes on after the last batch done."""

    def write(batch: DataFrame, number: int) -> None:
        postings(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed(rows: DataFrame, embed_batch: Callable[[list[str]], list[list[float] | None]], dim: int) -> DataFrame:
    """Z-02, Y-01: vectors of ``rows(id, text)`` by a batch function. A vector of another dimension is a failure of its row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = embed_batch(f["text"].tolist())
            good = [v is not None and len(v) == dim for v in made]
            yield pd.DataFrame({"id": f["id"], "vector": [list(map(float, v)) if g else None for v, g in zip(made, good)], "reason": [None if g else "dimension" for g in good]})

    return rows.select("id", "text").mapInPandas(run, "id long, vector array<double>, reason string")


class ServiceUnavailable(Exception):
    """Raised by a batch function whose service is out of reach: the job stops, and no row is blamed for it."""


def backfill(candidates: DataFrame, excluded: DataFrame, path: str, embed_batch: Callable[[list[str]], list[list[float] | None]], dim: int, parts: int = 1) -> DataFrame:
    """Z-02: vectors for ``candidates(id, text)`` that are neither at ``path`` nor excluded, and the rows made, ``(id, vector, reason)``.

    A row that fails has no vector but a reason, at ``path`` too, and is not tried again. Parts of the ids are committed one
    by one; where the service fails, the parts before stay, the part at hand leaves nothing, and the next call goes on there.
    """
    spark = candidates.sparkSession
    schema = "id long, vector array<double>, reason string, part int"

    def stored() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # nothing has been made yet
            return spark.createDataFrame([], schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 32):
                few = f.iloc[at : at + 32]
                made = _each(embed_batch, few["text"].tolist(), dim)
                yield pd.DataFrame({"id": few["id"], "vector": [v for v, _ in made], "reason": [r for _, r in made]})

    for part in range(parts):
        mine = candidates.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        todo = mine.join(stored().select("id"), "id", "left_anti").join(excluded.select("id"), "id", "left_anti").select("id", "text")
        todo.mapInPandas(run, "id long, vector array<double>, reason string").withColumn("part", F.lit(part)).write.mode("append").parquet(path)
    return stored().select("id", "vector", "reason")


def _each(embed_batch, texts: list[str], dim: int) -> list[tuple[list[float] | None, str | None]]:
    """Vectors of a batch; where the batch fails, of its texts one by one."""
    try:
        made = embed_batch(texts)
    except ServiceUnavailable:
        raise
    except Exception as e:
        if len(texts) > 1:
            return [x for one in texts for x in _each(embed_batch, [one], dim)]
        return [(None, f"embedding failed: {e}")]
    return [(list(map(float, v)), None) if v is not None and len(v) == dim else (None, "dimension") for v in made]


#: In place of a time, in microseconds, for an event without one: before all others.
OLDEST = -(1 << 62) // 1000
#: Events in a value of state at most.
PIECE = 100_000


class LatestRating(StatefulProcessor):
    """Z-03: for each target, the latest event that is neither undone nor superseded; a correction may come before its event.

    A target without such an event gives nulls, which take back what was given for it before.

    With ``keep`` seconds, the state of a target is what its newest event so far reaches back over, and the latest event
    standing before that, which is settled. An event older than that span is given back as ``late`` and changes nothing; so is one
    that supersedes what is settled, though it still counts as an event of its own. A batch is judged as a whole: what it
    holds is in time or late by the batches before it.
    """

    def __init__(self, keep: float | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Events of a batch are one value, or one for each PIECE, as an Arrow file: a call for each event took most of the time.
        self.events = handle.getListState("events", "rows binary")
        self.gone = handle.getListState("gone", "rows binary")
        self.span = handle.getValueState("span", "horizon long, settled long")

    @staticmethod
    def _all(state, new: pd.DataFrame) -> tuple[pd.DataFrame, int]:
        """The last row of each event_id in the state and then ``new``, and how many values the state has."""
        had = [pa.ipc.open_file(pa.py_buffer(bytes(x[0]))).read_pandas() for x in state.get()] if state.exists() else []
        rows = pd.concat([x for x in (*had, new) if len(x)] or [new], ignore_index=True)
        return rows.drop_duplicates("event_id", keep="last", ignore_index=True), len(had)

    @staticmethod
    def _packed(rows: pd.DataFrame) -> list[tuple[bytes]]:
        out = []
        for i in range(0, len(rows), PIECE):
            table, sink = pa.Table.from_pandas(rows.iloc[i : i + PIECE], preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_file(sink, table.schema) as file:
                file.write_table(table)
            out.append((sink.getvalue().to_pybytes(),))
        return out

    def _put(self, state, rows: pd.DataFrame) -> None:
        state.put(self._packed(rows)) if len(rows) else state.clear()

    def _add(self, state, new: pd.DataFrame, rows: pd.DataFrame, values: int) -> None:
        """``new`` as a value of its own; many small values become one."""
        if values >= 32 and values > 2 * len(rows) / PIECE:
            self._put(state, rows)
        elif len(new):
            state.appendList(self._packed(new))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        horizon, settled = self.span.get() if self.span.exists() else (None, None)
        batch = pd.concat(list(rows), ignore_index=True)
        times = batch["created_at"].to_numpy("datetime64[us]")
        batch = batch.assign(at=np.where(np.isnat(times), OLDEST, times.view(np.int64)), undone=batch["undone_at"].notna(), event_id=batch["event_id"].astype("int64"))
        old = (batch["at"] < horizon) if horizon is not None else pd.Series(False, index=batch.index)
        corrects = ~old & batch["supersedes_event_id"].notna()
        vain = corrects & (batch["supersedes_event_id"] == settled) if settled is not None else ~corrects & corrects
        events, hits = batch.loc[~old, ["event_id", "rating", "at", "undone"]], batch[corrects & ~vain]
        hits = pd.DataFrame({"event_id": hits["supersedes_event_id"].astype("int64"), "at": hits["at"]})
        (known, events_in), (gone, gone_in) = self._all(self.events, events), self._all(self.gone, hits)
        live = known[~known["undone"].astype(bool) & ~known["event_id"].isin(gone["event_id"])].sort_values(["at", "event_id"])
        if self.keep is None:
            self._add(self.events, events, known, events_in)
            self._add(self.gone, hits, gone, gone_in)
        elif len(known):
            newest = int(known["at"].max()) - int(self.keep * 1_000_000)
            horizon = newest if horizon is None else max(horizon, newest)
            base = live.loc[live["at"] < horizon, "event_id"].iloc[-1:]
            self._put(self.events, known[(known["at"] >= horizon) | known["event_id"].isin(base)])
            self._put(self.gone, gone[gone["at"] >= horizon])
            self.span.update((horizon, int(base.iloc[0]) if len(base) else None))
        # The latest one, or nulls, and then what is late.
        best, late = live.iloc[-1:], batch[old | vain]
        found = [*(best if len(best) else pd.DataFrame({"event_id": [None], "rating": [None], "at": [OLDEST]}))[["event_id", "rating", "at"]].itertuples(index=False, name=None), *late[["event_id", "rating", "at"]].itertuples(index=False, name=None)]
        ids, ratings, at = zip(*found)
        at = [pd.NaT if x == OLDEST else pd.Timestamp(x, unit="us") for x in at]
        yield pd.DataFrame({"target_id": [key[0]] * len(found), "event_id": pd.array(ids, dtype="Int64"), "rating": ratings, "created_at": pd.Series(at, dtype="datetime64[ns]"), "late": [False] + [True] * len(late)})

    def close(self) -> None:
        pass


LATEST = "target_id long, event_id long, rating string, created_at timestamp, late boolean"


def ratings_and_late(stream: DataFrame, keep: float | None = None) -> DataFrame:
    """Z-03: ``latest_ratings``, and the events that came too late for them, told apart by ``late``: two outputs of one query."""
    return stream.groupBy("target_id").transformWithStateInPandas(LatestRating(keep), LATEST, "update", "none")


def latest_ratings(stream: DataFrame, keep: float | None = None) -> DataFrame:
    """Z-03: the latest rating of each target that has new events; ``keep`` bounds its state, in seconds of its events' time."""
    return ratings_and_late(stream, keep).where("not late").drop("late")


class OnlineClips(StatefulProcessor):
    """Z-06: clips of arriving frames; a clip closes after a gap, at its longest span, or when its timer runs out."""

    def __init__(self, gap: float, longest: float):
        self.gap, self.longest = gap, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start double, last double, frames long, score double")

    def _out(self, key, c) -> pd.DataFrame:
        return pd.DataFrame({"video": [key[0]], "start": [c[0]], "end": [c[1]], "frames": [c[2]], "score": [c[3]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.open.get() if self.open.exists() else None
        for f in pd.concat(list(rows)).sort_values("ts").itertuples():
            if now is not None and (f.ts - now[1] > self.gap or f.ts - now[0] > self.longest):
                yield self._out(key, now)
                now = None
            now = (f.ts, f.ts, 1, f.score) if now is None else (now[0], max(now[1], f.ts), now[2] + 1, max(now[3], f.score))
        self.open.update(tuple(now))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((now[1] + self.gap) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            yield self._out(key, self.open.get())
            self.open.clear()

    def close(self) -> None:
        pass


def online_clips(stream: DataFrame, gap: float = 15.0, longest: float = 24.0, late: str = "1 minute") -> DataFrame:
    """Z-06: ``stream(video, ts, score, event_time)``; ts is event_time in seconds. Frames later than ``late`` are dropped."""
    rows = stream.withWatermark("event_time", late)
    return rows.groupBy("video").transformWithStateInPandas(OnlineClips(gap, longest), "video long, start double, end double, frames long, score double", "append", "eventtime")


def progress(frames: DataFrame) -> DataFrame:
    """A-02, Z-05: frames in all, done, failed and pending, which is the rest; on a stream in complete mode."""
    status = F.col("status")
    counts = frames.groupBy().agg(F.count("*").alias("total"), F.count_if(status == "done").alias("done"), F.count_if(status == "failed").alias("failed"))
    return counts.withColumn("pending", F.col("total") - F.col("done") - F.col("failed"))


def throughput(scored: DataFrame, every: str = "10 minutes") -> DataFrame:
    """Z-05: frames ``(status, finished_at)`` done and failed in each window of time, and seconds for each of them."""
    over = scored.where(F.col("status").isin("done", "failed"))
    out = over.groupBy(F.window("finished_at", every).alias("w")).agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    span = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return out.select(F.col("w.start").alias("start"), "done", "failed", F.round(span / (F.col("done") + F.col("failed")), 6).alias("seconds_each"))


def remaining(counts: DataFrame, rates: DataFrame) -> DataFrame:
    """Z-05: pending frames, seconds for each at the last window's pace, and hours left; no hours where no window is known."""
    last = rates.agg(F.max_by("seconds_each", "start").alias("seconds_each"))
    return counts.select("pending").crossJoin(F.broadcast(last)).withColumn("hours", F.round(F.col("pending") * F.col("seconds_each") / 3600, 6))


def once_only(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Z-07 on a stream: one row for each id within the watermark."""
    return stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_id"])
