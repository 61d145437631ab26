"""Position reports in CSV as a data source: `spark.read.format("ais")`.

Files are read by byte ranges; a record belongs to the range in which its first byte lies, also where a quoted field holds line
ends. Whether a range begins within quotes depends on all quotes before it, so read() first counts the quotes of each range (a
pass of its own, only where a file has more than one), and hands on the ranges that do.

mode strict (for figures of transitions): a record that is not UTF-8 is rejected, a course that is blank counts as 0.
mode lenient (for figures of sequences): bytes that are not UTF-8 are dropped, there is no course.
Rejected records, with file, place and reason, are the other table of the same files (option rejected).
"""

from __future__ import annotations

import csv
import datetime
import io
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POINTS = {"strict": "mmsi bigint, t_s double, lat double, lon double, sog double, cog double", "lenient": "mmsi bigint, t_s double, lat double, lon double, sog double"}
REJECTED = "file string, place bigint, line string, reason string"
QUOTES = "file string, start bigint, quotes bigint"
SPLIT_BYTES, ROWS = 64 << 20, 8192
TIME = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d", re.A)
EPOCH = datetime.datetime(1970, 1, 1)  # noqa: DTZ001  (reports have no zone)


class Rejected(ValueError):
    """Why a record is no report."""


def number(record: dict, name: str, blank: float | None = None, strip: bool = False) -> float:
    """A field's number; `blank` stands for an absent or empty one (with strip: also for blanks only)."""
    text = record.get(name)
    if blank is not None and (not text or strip and not text.strip()):
        return blank
    try:
        value = float(text)
    except (TypeError, ValueError):
        raise Rejected(f"{name} is no number") from None
    if not math.isfinite(value):
        raise Rejected(f"{name} is no number")
    return value


def report(record: dict, mode: str) -> tuple:
    """The columns of POINTS, or Rejected."""
    vessel = (record.get("MMSI") or "").strip()
    if not re.fullmatch(r"[+-]?\d{1,18}", vessel, re.A):
        raise Rejected("MMSI is no number")
    text = (record.get("BaseDateTime") or "").strip()
    try:
        seconds = (datetime.datetime.fromisoformat(text) - EPOCH).total_seconds() if TIME.fullmatch(text) else None
    except ValueError:
        seconds = None
    if seconds is None:
        raise Rejected("BaseDateTime is no time")
    row = (int(vessel), seconds, number(record, "LAT"), number(record, "LON"), number(record, "SOG", 0.0))
    return (*row, number(record, "COG", 0.0, strip=True)) if mode == "strict" else row


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int
    within_quotes: bool = False


def opened(file: str) -> io.BufferedReader:
    where, path = fs.FileSystem.from_uri(file)
    return io.BufferedReader(where.open_input_file(path), 1 << 20)


def records(f: io.BufferedReader, part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the records that begin in the range."""
    inside = part.within_quotes
    f.seek(max(0, part.start - 1))
    if part.start:
        before = f.read(1)
        if inside or before != b"\n":  # the rest of a record of the range before
            while line := f.readline():
                inside ^= line.count(b'"') % 2 == 1
                if not inside:
                    break
    while (place := f.tell()) < part.end:
        record = line = f.readline()
        inside = line.count(b'"') % 2 == 1
        while inside and (line := f.readline()):
            record += line
            inside ^= line.count(b'"') % 2 == 1
        yield place, record


def fields(record: bytes, mode: str) -> list[str]:
    try:
        text = record.decode("utf-8", "strict" if mode == "strict" else "ignore")
    except UnicodeDecodeError:
        raise Rejected("not UTF-8") from None
    return next(csv.reader(io.StringIO(text, newline="")), [])


class AisReader(DataSourceReader):
    def __init__(self, options: dict, schema: str):
        self.options, self.schema = options, pa_schema(schema)
        self.mode, self.split = options.get("mode", "strict"), int(options.get("splitbytes", SPLIT_BYTES))
        self.what = "quotes" if options.get("quotes") == "true" else "rejected" if options.get("rejected") == "true" else "points"

    def partitions(self) -> list[ByteRange]:
        within = {tuple(x) for x in json.loads(self.options.get("withinquotes", "[]"))}
        out = []
        for path in json.loads(self.options["files"]) if "files" in self.options else [self.options["path"]]:
            where, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            info = where.get_file_info(name)
            found = [info] if info.is_file else sorted((x for x in where.get_file_info(fs.FileSelector(name, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
            head = path[: path.index("://") + 3] if "://" in path else "file://"
            host = path[len(head) :].split("/", 1)[0] if "://" in path and not head.startswith("file") else ""
            for x in found:
                file = f"{head}{host}{'' if x.path.startswith('/') else '/'}{x.path}" if not host or not x.path.startswith(host) else f"{head}{x.path}"
                out += [ByteRange(file, k, min(k + self.split, x.size), (file, k) in within) for k in range(0, x.size, self.split)]
        return out

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self.rows(part):
            rows.append(row)
            if len(rows) == ROWS:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)

    def rows(self, part: ByteRange) -> Iterator[tuple]:
        with opened(part.file) as f:
            if self.what == "quotes":
                f.seek(part.start)
                left, quotes = part.end - part.start, 0
                while left and (data := f.read(min(left, 4 << 20))):
                    quotes, left = quotes + data.count(b'"'), left - len(data)
                yield part.file, part.start, quotes
                return
            header = fields(next(records(f, ByteRange(part.file, 0, 1)))[1], "lenient")
            if header:
                header[0] = header[0].removeprefix("\ufeff")
            for place, record in records(f, part):
                if not place or not record.strip():
                    continue  # the header, empty lines
                try:
                    row, why = report(dict(zip(header, fields(record, self.mode), strict=False)), self.mode), None
                except Rejected as e:
                    row, why = None, str(e)
                if self.what == "points" and row:
                    yield row
                elif self.what == "rejected" and why:
                    yield part.file, place, record.decode("utf-8", "replace").rstrip("\r\n"), why


def pa_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


class AisSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ais"

    def schema(self) -> str:
        mode = self.options.get("mode", "strict")
        if mode not in POINTS:
            raise ValueError(f"mode must be one of {', '.join(POINTS)}")
        return QUOTES if self.options.get("quotes") == "true" else REJECTED if self.options.get("rejected") == "true" else POINTS[mode]

    def reader(self, schema) -> AisReader:  # noqa: ANN001, ARG002
        return AisReader({k.lower(): v for k, v in self.options.items()}, self.schema())


def read(spark: SparkSession, path: str, mode: str = "strict", *, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Reports and rejected records of a file, or of all files below a folder, each with a header."""
    spark.dataSource.register(AisSource)
    source = lambda **more: spark.read.format("ais").options(mode=mode, splitBytes=str(split_bytes), **more).load(path)
    quotes = source(quotes="true")
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    within = quotes.withColumn("before", before).where("before % 2 = 1").select("file", "start").collect()  # the ranges that begin within quotes
    told = {"withinQuotes": json.dumps([[r["file"], r["start"]] for r in within])}
    return source(**told), source(rejected="true", **told)
