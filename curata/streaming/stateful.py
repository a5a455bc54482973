"""Stateful streams: the folds of ``operators.folds`` and the tracker, with typed state kept by key across micro-batches.

A fold's values are a value of the state store, its window a list, and a session's live tracks a map, each by columns of their own.
Rows of a micro-batch are folded in the order of ``order``; a row that arrives in a later batch is
later by definition, whatever its time. In a stream that runs on, give ``idle_ms``: state that wasn't written for so long is
dropped by the store, so that ended sessions don't stay for ever. ``ended_tracks`` ends tracks by event time instead: timers
fire as the watermark passes, whether or not their session has another row.

These streams need the state store that has typed state; ``typed_store`` chooses it for queries that are started from then on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from curata.operators import arrow
from curata.operators.boxes import Tracker
from curata.operators.folds import Fold, readings

CORNERS = ("x1", "y1", "x2", "y2")


def _fields(ddl: str) -> list[T.StructField]:
    return list(T._parse_datatype_string(ddl).fields)


def typed_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(rows: Iterator[Row], order: list[str]) -> list[Row]:
    """Rows sorted by columns, nulls first."""
    return sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in order))


class FoldProcessor(StatefulProcessor):
    """Runs one fold a key: ``values`` is a value state of the fold's ``keeps``, ``window`` a list state of its ``holds``."""

    def __init__(self, fold: Callable[[], Fold], columns: list[str], order: list[str], idle_ms: int | None):
        self.fold, self.columns, self.order, self.idle_ms = fold, columns, order, idle_ms
        self.given = [f.name for f in _fields(fold().gives)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        sample = self.fold()
        self.values = handle.getValueState("values", sample.keeps, self.idle_ms)
        self.window = handle.getListState("window", sample.holds, self.idle_ms) if sample.holds else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        machine = self.fold()
        if self.values.exists():
            machine.values = tuple(self.values.get())
            if self.window is not None:
                machine.window = tuple(tuple(x) for x in self.window.get())
        for row in in_order(rows, self.order):
            found = machine.step(*readings(row[c] for c in machine.reads))
            yield Row(**{c: row[c] for c in self.columns}, **dict(zip(self.given, found, strict=True)))
        self.values.update(machine.values)
        if self.window is not None:
            self.window.put(list(machine.window)) if machine.window else self.window.clear()

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, keys: list[str], order: list[str], fold: Callable[[], Fold], idle_ms: int | None = None) -> DataFrame:
    """``stream`` with a fold's columns; the same rows as ``fold_batch`` where batches follow the order."""
    typed_store(stream.sparkSession)
    schema = T.StructType([*stream.schema.fields, *_fields(fold().gives)])
    return stream.groupBy(*keys).transformWithState(FoldProcessor(fold, stream.columns, order, idle_ms), schema, "Append", "ProcessingTime" if idle_ms else "None")


#: Rows of a packed row that a session gives.
PACK = 10_000


def _packed(stream: DataFrame, session: str, columns: list[str], time: str | None = None) -> DataFrame:
    """(session, rows), and the latest ``time``: the rows of a session that lie in one Arrow batch travel as one row, as Arrow's bytes of
    ``columns``, since a stateful Python stream takes its rows, and their values, one by one."""
    schema = _arrow(stream, columns)
    kinds = [T.StructField(session, stream.schema[session].dataType), T.StructField("rows", T.BinaryType()), *([T.StructField(time, stream.schema[time].dataType)] if time else [])]

    def pack(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch, sort_keys=[(session, "ascending")]))
            keys = batch.column(session).to_pylist()
            starts = [0, *(n for n in range(1, len(keys)) if not arrow.same(keys[n], keys[n - 1])), len(keys)]
            own = pa.RecordBatch.from_arrays([batch.column(c) for c in columns], schema=schema)
            pairs = list(zip(starts[:-1], starts[1:], strict=True))
            out = [batch.column(session).take(pa.array(starts[:-1])), pa.array([own.slice(x, y - x).serialize().to_pybytes() for x, y in pairs], pa.binary())]
            if time:
                out.append(pa.array([pc.max(batch.column(time).slice(x, y - x)) for x, y in pairs], batch.column(time).type))
            yield pa.RecordBatch.from_arrays(out, names=[k.name for k in kinds])

    return stream.mapInArrow(pack, T.StructType(kinds))


def _arrow(df: DataFrame, columns: list[str]):
    import pyarrow as pa

    return pa.schema(arrow.arrow_fields([T.StructField(c, df.schema[c].dataType) for c in columns]))


def _unpacked(packed: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of ``rows``, which have a schema."""
    given = arrow.arrow_fields(schema.fields)

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            for held in batch.column("rows"):
                yield pa.ipc.read_record_batch(held.as_buffer(), pa.schema(given))

    return packed.mapInArrow(unpack, schema)


class TrackProcessor(StatefulProcessor):
    """Runs one tracker a session over rows of ``_packed``: the next id is a value, the live tracks are a map from track to its last frame and
    corners. Rows are given packed, with the columns ``keep``."""

    def __init__(self, frame: str, schema, keep: list[str], settings: dict, idle_ms: int | None = None):
        self.frame, self.schema, self.keep, self.settings, self.idle_ms = frame, schema, keep, settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next_id = handle.getValueState("next_id", "next_id long", self.idle_ms)
        self.tracks = handle.getMapState("tracks", "track_id long", "frame long, x1 double, y1 double, x2 double, y2 double", self.idle_ms)

    def tracked(self, rows) -> tuple:
        """The Arrow table of the rows, in order of frame and box, and their track ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(r["rows"])), self.schema) for r in rows], self.schema)
        table = table.take(pc.sort_indices(table, sort_keys=[(self.frame, "ascending"), ("box_id", "ascending")], null_placement="at_start"))
        tracker, before = Tracker(**self.settings), {}
        if self.next_id.exists():
            before = {k[0]: tuple(v) for k, v in self.tracks.iterator()}
            # in order of their ids, as of equal scores the first track wins
            tracker.state = (self.next_id.get()[0], tuple((i, v[0], v[1:]) for i, v in sorted(before.items())))
        ids = tracker.steps(table.column(self.frame).to_pylist(), arrow.rows(table, ["confidence", *CORNERS]))
        next_id, live = tracker.state
        self.next_id.update((next_id,))
        for gone in before.keys() - {t[0] for t in live}:
            self.tracks.removeKey((gone,))
        for track_id, number, corners in live:
            if before.get(track_id) != (number, *corners):
                self.tracks.updateValue((track_id,), (number, *map(float, corners)))
        return table, ids

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        import pyarrow as pa

        table, ids = self.tracked(rows)
        given = table.select(self.keep).append_column("track_id", pa.array(ids, pa.int64())).combine_chunks()
        for batch in given.to_batches(PACK):
            yield Row(rows=batch.serialize().to_pybytes())

    def close(self) -> None:
        pass


def track_stream(stream: DataFrame, session: str = "session", frame: str = "frame", settings: dict | None = None, idle_ms: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``stream`` of box rows with ``track_id``, or its columns ``keep`` alone: each column costs time a row on its way. A frame's boxes have to
    arrive in one micro-batch; tracks age by frame numbers, so frames without a box need not be sent."""
    typed_store(stream.sparkSession)
    kept = keep or stream.columns
    read = [c for c in stream.columns if c in {*kept, frame, "box_id", "confidence", *CORNERS}]
    processor = TrackProcessor(frame, _arrow(stream, read), kept, settings or {}, idle_ms)
    found = _packed(stream, session, read).groupBy(session).transformWithState(processor, "rows binary", "Append", "ProcessingTime" if idle_ms else "None")
    return _unpacked(found, T.StructType([*(stream.schema[c] for c in kept), T.StructField("track_id", T.LongType())]))


class EndedTracks(TrackProcessor):
    """Tracks that have ended: a span a track is kept, and a timer a session at the first end of a track's patience. When it fires, all tracks end that
    the watermark has passed, and the next end is waited for. Times are microseconds in the column ``_us``."""

    def __init__(self, session: str, frame: str, schema, after_ms: int, settings: dict):
        super().__init__(frame, schema, [], settings)
        self.session, self.after_ms = session, after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.spans = handle.getMapState("spans", "track_id long", "first_seen long, last_seen long, n_boxes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found: dict = {}
        table, ids = self.tracked(rows)
        for us, track_id in zip(table.column("_us").to_pylist(), ids, strict=True):
            if track_id is not None and us is not None:
                found.setdefault(track_id, []).append(us)
        known = {k[0]: tuple(v) for k, v in self.spans.iterator()}
        for track_id, times in found.items():
            first, last, n = known.get(track_id, (min(times), max(times), 0))
            known[track_id] = (min(first, *times), max(last, *times), n + len(times))
            self.spans.updateValue((track_id,), known[track_id])
        self._wait(known)
        return iter(())

    def _wait(self, spans: dict) -> None:
        """A session has one timer, for the first of its tracks that may end."""
        if spans:
            self.handle.registerTimer(min(self._due(last) for _, last, _ in spans.values()))

    def _due(self, last: int) -> int:
        return -(-last // 1000) + self.after_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, left = timerValues.getCurrentWatermarkInMs(), {}
        for (track_id,), (first, last, n) in sorted(self.spans.iterator(), key=lambda x: x[0][0]):
            if self._due(last) <= now:
                self.spans.removeKey((track_id,))
                yield Row(**{self.session: key[0], "track_id": track_id, "first_seen": first, "last_seen": last, "n_boxes": n})
            else:
                left[track_id] = (first, last, n)
        self._wait(left)


def ended_tracks(stream: DataFrame, time: str, after: float, session: str = "session", frame: str = "frame", late: str = "0 seconds", settings: dict | None = None) -> DataFrame:
    """(session, track_id, first_seen, last_seen, n_boxes) of each track, once event time is ``after`` seconds past its last box; the
    rows of ``boxes.track_spans``. ``late`` is the watermark's delay. A track that ends in a stream's last ``after`` seconds isn't given yet."""
    typed_store(stream.sparkSession)
    at = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("_us", F.unix_micros(time))
    read = [frame, "box_id", "confidence", *CORNERS, "_us"]
    processor = EndedTracks(session, frame, _arrow(at, read), round(after * 1000), settings or {})
    schema = T.StructType([T.StructField(session, stream.schema[session].dataType), *_fields("track_id long, first_seen long, last_seen long, n_boxes long")])
    # the latest time of the rows that travel together moves the watermark as each of them would
    packed = _packed(at, session, read, time).withWatermark(time, late)
    ended = packed.groupBy(session).transformWithState(processor, schema, "Append", "EventTime")
    return ended.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen")})


def windowed_counts(stream: DataFrame, time: str, keys: list[str], length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window_start, keys, n) by event time, tumbling or sliding; rows later than the watermark are left out."""
    at = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return at.groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def session_windows(stream: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session_start, session_end, keys, n): sessions end after a gap of event time."""
    at = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return at.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def drop_repeats(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def join_streams(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Pairs of rows of two streams with equal keys, the right one up to ``within`` after the left one."""
    a = left.withColumn(left_time, F.col(left_time).cast("timestamp")).withWatermark(left_time, late).alias("a")
    b = right.withColumn(right_time, F.col(right_time).cast("timestamp")).withWatermark(right_time, late).withColumnsRenamed({k: f"right_{k}" for k in keys}).alias("b")
    on = F.expr(f"b.{right_time} >= a.{left_time} AND b.{right_time} <= a.{left_time} + INTERVAL {within}")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.right_{k}"))
    return a.join(b, on).drop(*[f"right_{k}" for k in keys])


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows; for tests and small outputs."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there into a Parquet table of the shared folder, which is written exactly once, and reads it."""
    from curata.session import shared_dir

    spark = stream.sparkSession
    path = shared_dir(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", shared_dir(spark, f"{name}-checkpoint")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
