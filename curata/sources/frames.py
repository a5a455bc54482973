"""Frames as a streaming source: logs of raw frames that devices append to a folder, read with offsets and bounded retries.

A device writes numbered segments, ``<device>-<number>.frames``: for each frame its 8-byte time in microseconds, its 4-byte
length and its bytes. ``frame_log`` streams the frames of all segments. An offset names how many segments of each device have been read, so a
restarted query goes on where it was and no frame comes twice; a device's segments are read once they are followed by a gapless
number. Each segment is a partition. Opening one that fails is tried again up to ``retries`` times, after a pause, before the
task fails; with ``skip_broken`` a segment that stays unreadable gives one row with its error instead, so a broken device doesn't stop the others.
"""

from __future__ import annotations

import json
import re
import struct
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from curata.session import filesystem, qualified

HEAD = "<qI"
SCHEMA = "device string, segment long, frame int, time timestamp, bytes binary, attempts int, error string"
_NAME = re.compile(r"(?P<device>.+)-(?P<number>\d+)\.frames$")


@dataclass
class Segment(InputPartition):
    device: str
    number: int
    path: str


def segment_name(device: str, number: int) -> str:
    return f"{device}-{number:08d}.frames"


def parse(data: bytes):
    """(time, bytes) of each frame; a log that breaks off within a frame is an error."""
    at = 0
    while at < len(data):
        if at + struct.calcsize(HEAD) > len(data):
            raise ValueError("segment ends within a frame's head")
        when, n = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        if at + n > len(data):
            raise ValueError("segment ends within a frame")
        yield when, data[at : at + n]
        at += n


class FrameReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.retries, self.pause = int(options.get("retries", 3)), float(options.get("pause", 0.5))
        self.skip_broken = options.get("skipbroken", options.get("skip_broken", "false")) == "true"
        self.most = int(options.get("persegments", options.get("per_segments", 0)))

    def _segments(self) -> dict[str, list[int]]:
        """The numbers of each device's segments."""
        from pyarrow import fs

        system, base = filesystem(self.folder)
        found: dict[str, list[int]] = {}
        for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if f.type == fs.FileType.File and (m := _NAME.match(f.base_name)):
                found.setdefault(m["device"], []).append(int(m["number"]))
        return found

    def initialOffset(self) -> dict:
        return {"read": json.dumps({})}

    def latestOffset(self) -> dict:
        """As many segments of each device as are there without a gap, from number 0."""
        read = {}
        for device, numbers in sorted(self._segments().items()):
            n = 0
            while n in set(numbers):
                n += 1
            if n:
                read[device] = n
        return {"read": json.dumps(read)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = json.loads(start["read"]), json.loads(end["read"])
        return [Segment(d, i, f"{self.folder.rstrip('/')}/{segment_name(d, i)}") for d in sorted(last) for i in range(first.get(d, 0), last[d])]

    def read(self, partition: Segment):
        import datetime as dt

        error = ""
        for attempt in range(1, self.retries + 2):
            try:
                system, path = filesystem(partition.path)
                with system.open_input_stream(path) as f:
                    found = list(parse(f.read()))
            except (OSError, ValueError) as broken:
                error = str(broken)
                if attempt <= self.retries:
                    time.sleep(self.pause)
                continue
            for i, (when, data) in enumerate(found):
                yield (partition.device, partition.number, i, dt.datetime.fromtimestamp(when / 1e6, dt.timezone.utc), data, attempt, None)
            return
        if not self.skip_broken:
            raise OSError(f"{partition.path} can't be read after {self.retries} retries: {error}")
        yield (partition.device, partition.number, None, None, None, self.retries + 1, error)

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))


def frame_log(spark: SparkSession, folder: str, retries: int = 3, pause: float = 0.5, skip_broken: bool = False) -> DataFrame:
    """A stream of (device, segment, frame, time, bytes, attempts, error) from the frame logs of a folder."""
    spark.dataSource.register(FrameSource)
    reader = spark.readStream.format("frames").option("path", qualified(spark, folder)).option("retries", str(retries)).option("pause", str(pause)).option("skip_broken", str(skip_broken).lower())
    return reader.load()


def write_frames(frames: DataFrame, folder: str, device: str = "device", time_: str = "time", data: str = "bytes", order: str | None = None, segments: int = 1) -> DataFrame:
    """Writes (device, time, bytes) as frame logs of ``segments`` segments a device, frames in order of time; returns (device, segment, n). A
    segment is one task's work and is written under its final name at once, so a task that is repeated writes it again."""
    spark = frames.sparkSession
    target = qualified(spark, folder)

    def run(key, rows):
        import pyarrow as pa

        (name, number), ordered = (k.as_py() for k in key), sorted(rows.to_pylist(), key=lambda r: (r["us"], r["by"]))
        system, base = filesystem(target)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{segment_name(name, number)}") as f:
            for r in ordered:
                f.write(struct.pack(HEAD, r["us"], len(r["data"])) + r["data"])
        return pa.table({"device": [name], "segment": [number], "n": pa.array([len(ordered)], pa.int64())})

    part = F.pmod(F.xxhash64(order or time_), F.lit(segments)).cast("long")
    rows = frames.select(F.col(device).cast("string").alias("device"), part.alias("segment"), F.unix_micros(F.col(time_)).alias("us"), F.coalesce(F.col(data), F.lit(b"")).alias("data"), F.col(order or time_).cast("string").alias("by"))
    # each device has all of its numbers, so that no gap holds the later ones back
    return rows.groupBy("device", "segment").applyInArrow(run, "device string, segment long, n long")
