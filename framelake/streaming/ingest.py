"""Incremental ingestion: what a resumed run does with markers and scans is a file source with a checkpoint here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.annotations import FRAME

#: The store that keyed state with timers needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Frames whose state is one value; what orders the lines of a frame.
SPAN = 1024
PLACE = ["written", "file", "block", "at"]

#: Bytes of lines that a task holds to make packs of them, and of a pack.
HELD, PACK = 16 << 20, 1 << 20

#: Bytes that go to Python at once: packs are large rows, and each task's Python keeps the memory of the largest batch.
ARROW_BYTES = 4 << 20

#: Bytes of incoming files, as they lie there, for which the state gets a partition.
STATE_BYTES = 128 << 20


def frame_stream(spark: SparkSession, path: str, files_each: int = 64) -> DataFrame:
    """Frames as files arrive; broken lines are left out."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_each).text(path)
    return raw.select(F.from_json("value", FRAME).alias("f"), F.col("_metadata.file_name").alias("file")).where("f.sample_index is not null").select("f.*", "file")


def once_each(frames: DataFrame, time: str = "utc_us", late: str = "10 minutes") -> DataFrame:
    """The first row of each (flight, sample_index); state is dropped once a frame is `late` behind the newest."""
    timed = frames.withColumn("at", F.timestamp_micros(F.coalesce(F.col(time), F.lit(0))))
    return timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["flight", "sample_index"])


def line_stream(spark: SparkSession, path: str, files_each: int = 64) -> DataFrame:
    """Frames' lines as files arrive, in packs: the lines of neighbouring frames that lie together in a file, of each frame the last one.

    flight, span (of SPAN frames), written (when the file was), file, block (of the file, as it was read), at (order of packs in a block), sample_index
    and value (the lines, in the order of sample_index, a line break between two). Broken lines are left out.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", files_each).option("maxFileAge", "36500d").text(path)  # how late is too late is said once, by latest_wins()
    place = F.unix_micros("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")
    parsed = raw.select(F.from_json("value", "flight string, sample_index long").alias("f"), *place, "value")
    rows = parsed.select(F.coalesce("f.flight", F.lit("")).alias("flight"), "f.sample_index", "written", "file", "block", "value")

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, 0
        for batch in batches:
            held.append(batch.filter(pc.is_valid(batch["sample_index"])))  # here, as a filter in the plan would parse each line again
            size += batch.nbytes
            if size >= HELD:
                yield from packed(held, at)
                held, size, at = [], 0, at + 1
        yield from packed(held, at)

    return rows.mapInArrow(packs, "flight string, span long, written long, file string, block long, at long, sample_index array<long>, value string")


def packed(batches: list[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Packs of lines that were read one after the other; a pack ends at about PACK bytes of text."""
    rows = pa.Table.from_batches(batches) if batches else None
    if not rows:
        return
    index, n = rows["sample_index"].to_numpy(), rows.num_rows
    span = index // SPAN
    codes = [pc.dictionary_encode(rows[c].combine_chunks()).indices.to_numpy() for c in ("flight", "file")]
    keys = [codes[0], span, codes[1], rows["block"].to_numpy(), index]
    order = np.lexsort(keys[::-1])  # stable: of equal ones the last comes last
    new = [np.concatenate([[True], (k := key[order])[1:] != k[:-1]]) for key in keys]
    last = np.append(np.any(new, axis=0)[1:], True)
    order = order[last]
    begins = np.diff(np.cumsum(np.any(new[:4], axis=0))[last], prepend=0) > 0  # at the first line kept of each pack
    lines = rows["value"].combine_chunks().take(pa.array(order))
    begins[1:] |= np.diff(np.cumsum(pc.binary_length(lines).to_numpy().astype("int64")) // PACK) > 0
    starts = np.flatnonzero(begins)
    offsets = pa.array(np.append(starts, len(order)).astype("int32"))
    firsts = rows.select(["flight", "written", "file", "block"]).take(pa.array(order[starts])).combine_chunks()
    one = lambda c: firsts[c].combine_chunks()
    columns = {
        "flight": one("flight"), "span": pa.array(span[order[starts]]), "written": one("written"), "file": one("file"), "block": one("block"), "at": pa.array(np.full(len(starts), at)),
        "sample_index": pa.ListArray.from_arrays(offsets, pa.array(index[order])), "value": pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n"),
    }
    yield pa.RecordBatch.from_pydict(columns)


class Latest(StatefulProcessor):
    """Keeps the place of each frame's last line, for SPAN neighbouring frames in one value, as each call of the store costs as much as many frames; a line that isn't later is ignored. A frame's state goes by its group's timer, once the watermark has passed the last line."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # places that frames' last lines have, and for each frame of the span the number of its place, from 1 (0: none), and its version; the timer
        self.handle, self.seen = handle, handle.getValueState("seen", "written array<long>, file array<string>, block array<long>, at array<long>, place binary, version binary, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packs = [row for batch in rows for row in batch[[*PLACE, "sample_index", "value"]].itertuples(index=False, name=None)]
        if not packs:
            return
        places, place, version, timer = self._known()
        before = place != 0
        touched, base = np.zeros(SPAN, bool), key[1] * SPAN
        packs = [((int(written), str(file), int(block), int(at)), np.asarray(index) - base, value) for written, file, block, at, index, value in packs]
        packs.sort(key=lambda pack: pack[0])  # so what comes later wins; packs of one place differ in their frames
        for mine, index, _ in packs:
            # what was known before lets only later lines in; new lines come in their order
            older = np.array([False, *(p < mine for p in places)])
            wins = index[touched[index] | ~before[index] | older[place[index]]]
            places.append(mine)
            place[wins] = len(places)
            touched[wins] = True
        if not touched.any():
            return
        version[touched] += 1
        first = len(places) - len(packs) + 1
        out = []
        for k, (_, index, value) in enumerate(packs, first):
            own = touched[index] & (place[index] == k)
            if own.all():
                out.append((value, version[index].tolist()))
            elif own.any():
                lines = value.split("\n")
                out.append(("\n".join([lines[j] for j in np.flatnonzero(own)]), version[index[own]].tolist()))
        self._keep(places, place, version, timer)
        yield pd.DataFrame(out, columns=["value", "version"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        places, place, version, timer = self._known()
        gone = np.array([True, *(p[0] // 1000 <= until for p in places)])[place]
        place[gone], version[gone] = 0, 0
        self._keep(places, place, version, timer)
        return iter([])

    def _known(self) -> tuple[list[tuple], np.ndarray, np.ndarray, int | None]:
        """Places, each frame's number of these and version, the timer."""
        state = self.seen.get()
        if state is None:
            return [], np.zeros(SPAN, "int32"), np.zeros(SPAN, "int32"), None
        *places, place, version, timer = state
        return list(zip(*places, strict=True)), np.frombuffer(place, "<i4").copy(), np.frombuffer(version, "<i4").copy(), timer

    def _keep(self, places: list[tuple], place: np.ndarray, version: np.ndarray, timer: int | None) -> None:
        """The state, and one timer, for the frame whose state goes first."""
        used, place = np.unique(np.append(place, 0), return_inverse=True)  # 0 stays 0
        places = [places[k - 1] for k in used[1:]]
        first = min(p[0] for p in places) // 1000 if places else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if not places:
            self.seen.clear()
            return
        self.seen.update((*map(list, zip(*places, strict=True)), place[:-1].astype("<i4").tobytes(), version.astype("<i4").tobytes(), first))
        if timer != first:
            self.handle.registerTimer(first)

    def close(self) -> None:
        pass


def latest_wins(lines: DataFrame, late: str = "3650 days") -> DataFrame:
    """Frames with `version` from 1: a row whenever a later line of a frame comes. Of all rows of a frame the one with the greatest version is the latest. lines: from line_stream().

    A line is late if its file was written so long before the newest one: such lines no longer count, and what is known of a
    frame is kept until its last line is as old.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = lines.withColumn("seen", F.timestamp_micros("written")).withWatermark("seen", late).groupBy("flight", "span")
    found = rows.transformWithStateInPandas(Latest(), "value string, version array<int>", "append", "eventTime")
    each = found.select(F.explode(F.arrays_zip(F.split("value", "\n").alias("value"), "version")).alias("line"))
    return each.select(F.from_json("line.value", FRAME).alias("f"), "line.version").select("f.*", "version")


def counts_by_window(frames: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """start, flight, frames, boxes of closed windows of time."""
    timed = frames.withColumn("at", F.timestamp_micros("utc_us")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", width).alias("w"), "flight").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.size("shapes")).alias("boxes"))
    return out.select(F.col("w.start").alias("start"), "flight", "frames", "boxes")


def partitions_for(spark: SparkSession, path: str) -> int:
    """Partitions of state for what lies under path at the first call of write(): one for STATE_BYTES of it and for each core at least, and no more than a shuffle has."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, size // STATE_BYTES))


def write(frames: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Everything there is, appended once and for all as Parquet; a later call goes on after it.

    partitions: of the state, where a shuffle's number isn't wanted. Each of them is opened and written in every batch, whatever it holds. A checkpoint keeps its first number.
    """
    stream = frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    conf = frames.sparkSession.conf
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)} | ({} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)})
    own = {name: conf.get(name) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        return stream.start()  # the stream has taken a copy of the settings when this returns
    finally:
        for name, value in own.items():
            conf.set(name, value)
