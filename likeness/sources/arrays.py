"""One JSON array in one file, read by many tasks, however it is formatted.

Where a record begins cannot be told from the middle of a file: a brace may stand inside a
string. So every byte range is first looked at once on its own: whether it holds an odd number
of string quotes, and by how much the nesting changes, both if the range begins inside a string
and if it does not. These few numbers of each range, taken one after the other, tell in which
state every range begins. Then each range gives the records that begin in it and reads on to the
end of the last one.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 32 * 1024 * 1024
# Bytes that are read at once beyond a range, until its last record ends.
MORE_BYTES = 1024 * 1024
# Records that are given to Spark at once.
BATCH_RECORDS = 1024
# Tasks that look at ranges for the first time.
MOST_TASKS = 10_000
# Ranges of less than RANGE_BYTES; a task and a row on the driver for each is too much of more.
SMALL_RANGES = 256
MARKS = re.compile(rb'\\.|["{}\[\]]', re.DOTALL)
BLANKS = b" \t\r\n\xef\xbb\xbf"


def opened(path: str):
    """A file that can be read from any place. Paths as Spark gives them."""
    address = urlparse(path)
    if address.scheme in ("", "file"):
        return pa.OSFile(unquote(address.path), "rb")
    from pyarrow.fs import FileSystem

    store, place = FileSystem.from_uri(path)
    return store.open_input_file(place)


def moved(file, at: int, size: int) -> int:
    """The first place from ``at`` on that is not behind a backslash, so that no range begins
    between a backslash and what it escapes."""
    while 0 < at < size:
        file.seek(at - 1)
        chunk = file.read(min(256, size - at + 1))
        for i, byte in enumerate(chunk):
            if byte != 0x5C:
                return at + i
        at += len(chunk)
    return at


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, step, quotes): where brackets and braces stand and whether they open (1) or
    close (-1), and the number of string quotes before each."""
    place, step, quotes, seen = [], [], [], 0
    for found in MARKS.finditer(data):
        mark = found[0]
        if mark == b'"':
            seen += 1
        elif len(mark) == 1:
            place.append(found.start())
            step.append(1 if mark in b"{[" else -1)
            quotes.append(seen)
    return np.array(place, np.int64), np.array(step, np.int64), np.array([*quotes, seen], np.int64)


def summary(path: str, start: int, end: int, size: int) -> dict:
    """What a range does to the state: whether strings change sides, by how much the nesting
    changes if it begins outside and if it begins inside a string, and its first mark."""
    with opened(path) as file:
        start, end = moved(file, start, size), moved(file, end, size)
        file.seek(start)
        data = file.read(max(0, end - start))
    _, step, quotes = marks(data)
    odd = quotes[:-1] % 2 == 1
    return {
        "path": path, "start": start, "end": end, "flips": bool(quotes[-1] % 2),
        "outside": int(step[~odd].sum()), "inside": int(step[odd].sum()),
        "first": data.lstrip(BLANKS)[:1].decode("latin-1"),
    }


SUMMARY = "path string, start long, end long, flips boolean, outside long, inside long, first string"


def file_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """(path, start, end, size) of all files below ``path``; their contents are not read. Small
    ranges grow, up to RANGE_BYTES, where there were too many of them."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    total = files.agg(F.sum("size")).head()[0] or 0
    range_bytes = max(range_bytes, min(RANGE_BYTES, -(-total // SMALL_RANGES)))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    cut = files.filter("size > 0").select("path", "size", F.explode(starts).alias("start"))
    return cut.withColumn("end", F.least(F.col("start") + range_bytes, "size"))


def states(found: list[dict]) -> list[dict]:
    """The ranges of all files with the state each begins in; a file that does not end in the
    state it began in, or is no array or record, is an error."""
    ready, before = [], None
    for one in sorted(found, key=lambda r: (r["path"], r["start"], r["end"])):
        if before is None or one["path"] != before["path"]:
            _closed(before)
            inside, depth, base = False, 0, None
        if base is None and one["first"]:
            if one["first"] not in "[{":
                raise ValueError(f"{one['path']} is no JSON array")
            base = 1 if one["first"] == "[" else 0
        if one["start"] < one["end"]:
            ready.append({**one, "in_string": inside, "depth": depth, "base": base or 0})
        depth += one["inside"] if inside else one["outside"]
        inside ^= one["flips"]
        before = {"path": one["path"], "depth": depth, "in_string": inside}
    _closed(before)
    return ready


def _closed(last: dict | None) -> None:
    if last is not None and (last["depth"] or last["in_string"]):
        raise ValueError(f"{last['path']} ends within a record")


def records(part: dict) -> Iterator[bytes]:
    """The records that begin in a range, as they are written."""
    with opened(part["path"]) as file:
        file.seek(part["start"])
        data = file.read(part["end"] - part["start"])
        limit, depth, inside = len(data), part["depth"], part["in_string"]
        offset, begun, chunk = 0, None, data
        while True:
            place, step, quotes = marks(chunk)
            real = (quotes[:-1] % 2 == 1) == inside
            place, step = place[real] + offset, step[real]
            level = depth + np.cumsum(step)
            opens = place[(step == 1) & (level == part["base"] + 1)]
            ends = place[(step == -1) & (level == part["base"])]
            if begun is None:
                ends = ends[ends >= (opens[0] if len(opens) else len(data))]
            starts = [*([] if begun is None else [begun]), *opens.tolist()]
            stops = ends.tolist()
            for start, stop in zip(starts, stops):  # noqa: B905
                if start >= limit:
                    return
                yield data[start : stop + 1]
            begun = starts[len(stops)] if len(starts) > len(stops) else None
            if begun is None or begun >= limit:
                return
            # The last record goes on behind the range.
            depth, inside = depth + int(step.sum()), inside ^ bool(quotes[-1] % 2)
            file.seek(part["start"] + len(data))
            chunk = file.read(MORE_BYTES)
            while chunk.endswith(b"\\") and (more := file.read(1)):
                chunk += more
            if not chunk:
                raise ValueError(f"{part['path']} ends within a record")
            offset = len(data)
            data += chunk


class Range(InputPartition):
    def __init__(self, part: dict):
        super().__init__(json.dumps(part))


class ArrayReader(DataSourceReader):
    def __init__(self, ranges: list[dict]):
        self.ranges = ranges

    def __getstate__(self):
        """Each task is sent a reader, and its own range beside it; not all ranges."""
        return {"ranges": []}

    def partitions(self):
        return [Range(part) for part in self.ranges]

    def read(self, partition):
        held: list[str] = []
        for record in records(json.loads(partition.value)):
            held.append(record.decode())
            if len(held) >= BATCH_RECORDS:
                yield pa.record_batch([pa.array(held, pa.string())], names=["value"])
                held = []
        if held:
            yield pa.record_batch([pa.array(held, pa.string())], names=["value"])


class JsonArraySource(DataSource):
    """``value``: one row for each record of JSON arrays; ``ranges`` as ``states`` gives them."""

    @classmethod
    def name(cls):
        return "json_array_ranges"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return ArrayReader(json.loads(self.options["ranges"]))


def array_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(value): the text of each record of the JSON arrays in the files of ``path``.

    One row of numbers for each range comes to the driver. What is no record or array inside the
    array is passed over; a file that ends too early is an error. Files are read by place, so they
    must not be compressed; they lie where pyarrow reaches them (local, HDFS, S3, GCS).
    """
    ranges = file_ranges(spark, path, range_bytes)

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [summary(r["path"], r["start"], r["end"], r["size"]) for r in batch.to_pylist()]
            if rows:
                columns = {name: [r[name] for r in rows] for name in rows[0]}
                yield pa.RecordBatch.from_pydict(columns)

    listed = [tuple(r) for r in ranges.select("path", "start", "end", "size").collect()]
    if not listed:
        return spark.createDataFrame([], "value string")
    spread = spark.createDataFrame(listed, "path string, start long, end long, size long")
    spread = spread.repartition(min(len(listed), MOST_TASKS), "path", "start")
    found = [r.asDict() for r in spread.mapInArrow(looked_at, SUMMARY).collect()]
    spark.dataSource.register(JsonArraySource)
    told = json.dumps(states(found))
    return spark.read.format("json_array_ranges").option("ranges", told).load()
