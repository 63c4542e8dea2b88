"""Structured Streaming forms of the batch lanes; extensions, as the batch engine has none of them.

Each keeps state bounded by a watermark. Sinks write by batch id, so a batch that runs
again after a failure leaves the same rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.udf import in_arrow, reachable
from ..operators.chunking import CAPTION_SECONDS

if TYPE_CHECKING:
    import pandas as pd
    import pyarrow as pa


def new_entries(stream: DataFrame, key: str = "accession", time: str = "ts", delay: str = "7 days") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def _said(last: str | None, text: str) -> str:
    """What a cue says that the one before has not."""
    if last is None:
        return text
    return text[len(last) :].strip(" ") if text.startswith(last) else "" if last.endswith(text) else text


#: Seconds of a span: a video's cues of one span wait in one group.
SPAN = 86_400
#: Rows of _rolled(): what a cue adds; a span's first cue, which a cue of an earlier span may have said; a passed span's last one.
_ADDED, _FIRST, _LAST = 0, 1, 2
_ROLLED = "video string, at long, text string, span long, kind int"
#: The span that stands for all of a video's: its group knows the last cue of each.
_ALL = -(1 << 62)


def _with_last(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Cues (video, ts, at, text) with their span, and for the group of all spans the last cue of each video and span in a batch."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        spans = batch.column(2).to_numpy() // (span * 1_000_000)
        rows = pa.Table.from_batches([batch]).append_column("span", pa.array(spans, pa.int64()))
        yield from rows.to_batches()
        rows = rows.sort_by([(name, "ascending") for name in ("video", "span", "at", "text")])
        coded, spans = rows.column("video").combine_chunks().dictionary_encode().indices.to_numpy(), rows.column("span").to_numpy()
        last = np.flatnonzero((np.diff(coded, append=-1) != 0) | (np.diff(spans, append=-1) != 0))
        rows = rows.take(pa.array(last))
        yield from rows.set_column(4, "span", pa.array(np.full(len(rows), _ALL))).combine_chunks().to_batches()


def _rolled(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, seconds: int = SPAN) -> Iterator[pd.DataFrame]:
    """Holds the cues of a video's span until the watermark has passed them, then gives out, in order, what each adds.

    A key without a span is a video that is one span. Whenever the watermark moves, all groups are called that have cues to give
    out, and the one of all spans, which gives out the last cues of those passed since, and of one before: so what _joined() has
    to know of a batch is in the batch.
    """
    import pandas as pd

    video, span = key[0], int(key[1]) if len(key) > 1 else None
    last, held = state.get if state.exists else (None, [])
    held = [(r[0], r[1]) for r in held]
    for frame in frames:
        held += zip(frame["at"].tolist(), frame["text"].tolist())
    held.sort()
    watermark, out = state.getCurrentWatermarkMs(), []
    if span == _ALL:
        latest = {at // (seconds * 1_000_000): (at, text) for at, text in held}  # each span's last
        passed = [x for x in latest if (x + 1) * seconds * 1000 <= watermark]
        out = [(video, *latest[x], x, _LAST) for x in passed]
        state.update((None, [latest[x] for x in latest if x not in passed[:-1]]))
        state.setTimeoutTimestamp(max(watermark, 1))
        yield pd.DataFrame(out, columns=["video", "at", "text", "span", "kind"])
        return
    due = bisect_left(held, (watermark * 1000,))  # those before the watermark
    for at, text in held[:due]:
        said, kind, last = _said(last, text), _FIRST if last is None else _ADDED, text
        if said:
            out.append((video, at, said, span, kind))
    held = held[due:]
    end = None if span is None else (span + 1) * seconds * 1000
    if end is not None and end <= watermark:
        if state.exists:
            state.remove()
    else:
        state.update((last, held))
        if held or end is not None:
            state.setTimeoutTimestamp(max(held[0][0] // 1000 if held else end - 1, watermark, 1))
    yield pd.DataFrame(out, columns=["video", "at", "text", "span", "kind"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _rolled() gave out, each first cue of a span without what the last one of the span before said; they are few."""
    import pyarrow as pa
    import pyarrow.compute as pc

    firsts, lasts = [], {}
    for batch in batches:
        added = pc.equal(batch.column("kind"), _ADDED)
        yield batch.filter(added).select(["video", "at", "text"])
        for r in batch.filter(pc.invert(added)).to_pylist():
            if r["kind"] == _FIRST:
                firsts.append(r)
            else:
                lasts.setdefault(r["video"], {})[r["span"]] = r["text"]
    ordered = {video: sorted(x) for video, x in lasts.items()}
    out = []
    for r in firsts:
        spans = ordered.get(r["video"], [])
        before = bisect_left(spans, r["span"])
        said = _said(lasts[r["video"]][spans[before - 1]] if before else None, r["text"])
        if said:
            out.append({"video": r["video"], "at": r["at"], "text": said})
    yield pa.RecordBatch.from_pylist(out, pa.schema([("video", pa.string()), ("at", pa.int64()), ("text", pa.string())]))


def without_rollups(stream: DataFrame, delay: str = "10 minutes", span: int = SPAN) -> DataFrame:
    """video, at (microseconds) and text of cues (video, ts, text) without what rolling captions repeat, as the batch form of a file.

    A cue waits until the watermark has passed it, so one that comes late, but within delay, is still in its place. Cues of
    one time go by their text. State is the cues that wait, by spans of so many seconds, so a video of many cues is many
    groups, and each video's last text. Rows with nulls are left out.
    """
    reachable(stream.sparkSession)
    cues = stream.where("video is not null and ts is not null and text is not null").select("video", "ts", F.unix_micros("ts").alias("at"), "text")
    cues = in_arrow(cues, partial(_with_last, span=span), "video string, ts timestamp, at long, text string, span long").withWatermark("ts", delay)

    def rolled(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _rolled(key, frames, state, span)

    rows = cues.groupBy("video", "span").applyInPandasWithState(rolled, _ROLLED, "last string, held array<struct<at:long,text:string>>", "append", GroupStateTimeout.EventTimeTimeout)
    rows = rows.withColumn("part", F.when(F.col("kind") == _ADDED, F.col("span"))).repartition("video", "part")  # what one video's spans have to know of each other is together
    return in_arrow(rows, _joined, "video string, at long, text string")


def tumbling_captions(stream: DataFrame, delay: str = "10 minutes", seconds: int = CAPTION_SECONDS) -> DataFrame:
    """Cues (video, ts, text) gathered by windows of their start."""
    rows = stream.withWatermark("ts", delay).groupBy("video", F.window("ts", f"{seconds} seconds").alias("w"))
    parts = rows.agg(F.array_sort(F.collect_list(F.struct("ts", "text"))).alias("p"))
    return parts.select("video", F.col("w.start").alias("start"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def windowed_counts(stream: DataFrame, keys: list[str], time: str = "ts", window: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums of value by key and window, as a limiter of requests would ask for."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    rows = stream.withWatermark(time, delay).groupBy(*keys, span.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.select(*keys, F.col("w.start").alias("start"), "n", "value")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.where(F.col("n") > limit)


def sink_rows(spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """What a versioned sink holds: of complete results the last batch's, else what all batches brought."""
    rows = spark.read.parquet(path)
    if mode == "complete":
        rows = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0])
    return rows.drop("version")


def versioned_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes each batch as a version of its own; a version that fails leaves those before in place. sink_rows() reads them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id:08d}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
