"""Spark data source ``seglog``: directories of binary log segments.

Reading makes one partition per segment; a filter on ``seq`` skips segments
by their names alone, and bytes inside them by their index.  Option
``payload=false`` narrows the schema, which spares building and sending
payloads (a Python source is not column-pruned).  Checksums of all that is
read are verified, also in readers' scans, unless ``verify=false``.

Writing packs each task's rows, which must be a contiguous run of ``seq`` in
order, into segments of ``capacity`` bytes; names appear only on commit, by
rename, and an existing name is refused.  A commit first scans the last
segment and cuts what recovery leaves out, so that no torn end ever stands
before another segment.  Beside a segment stands its index: how many records
and bytes it has and where every ``STRIDE``-th starts.  An index counts only
while the segment has the bytes that it states; segments are complete
without theirs.

Streams follow ``seq`` as offset; a micro-batch sees durable records only, as
files appear whole, and at most ``maxRecordsPerBatch`` of them.

Paths go through pyarrow's file systems, so they may be URIs of any that it
knows; a plain path is local.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import codec
from ..schema import SCAN_SCHEMA, LogCorrupt, NoHistory

CAPACITY = 256 << 20
SUFFIX = ".seg"
#: Records from one place in an index to the next.
STRIDE = 4096
#: An index: records, bytes, then places (8 bytes each).
INDEX = struct.Struct("<QQ")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def base_of(name: str) -> int | None:
    """The base that a file name states; None for any other file."""
    digits = name[:-4]
    if not name.endswith(SUFFIX) or len(digits) != 20 or not (digits.isascii() and digits.isdigit()):
        return None
    return int(digits) if 0 < int(digits) < 1 << 64 else None


def segments(path: str) -> list[tuple[int, str]]:
    """(base, file), ascending; files of other names are ignored."""
    fs, root = file_system(path)
    found = [(base_of(f.base_name), f.path) for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.File]
    return sorted((b, p) for b, p in found if b is not None)


def load(path: str, file: str, start: int = 0, end: int | None = None) -> bytes:
    with file_system(path)[0].open_input_file(file) as f:
        f.seek(start)
        return f.read(None if end is None else end - start)


def index_of(file: str) -> str:
    return file[: -len(SUFFIX)] + ".idx"


def load_index(path: str, file: str) -> tuple[int, np.ndarray] | None:
    """(records, places and the end) of a segment, if its index is there and of its size."""
    fs, _ = file_system(path)
    found, own = fs.get_file_info([index_of(file), file])
    if found.type != pafs.FileType.File or found.size < INDEX.size:
        return None
    data = load(path, index_of(file))
    records, size = INDEX.unpack_from(data)
    if size != own.size or len(data) != INDEX.size + 8 * -(-records // STRIDE):
        return None
    return records, np.append(np.frombuffer(data, "<u8", offset=INDEX.size), size).astype(np.int64)


def next_seq(path: str) -> int:
    """The number that the next record will have: from the last segment's index, or a scan where it has none."""
    found = segments(path)
    if not found:
        return 1
    base, file = found[-1]
    index = load_index(path, file)
    return base + (index[0] if index else len(codec.scan(load(path, file), base).headers))


NOTE = ".admitted"


def note(path: str, what: dict) -> None:
    """Keep ``what`` beside the log, replacing what was kept before."""
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    own = f"{root}/{NOTE}-{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as out:
        out.write(json.dumps(what).encode())
    fs.move(own, f"{root}/{NOTE}")


def noted(path: str) -> dict | None:
    fs, root = file_system(path)
    there = fs.get_file_info(f"{root}/{NOTE}").type == pafs.FileType.File
    return json.loads(load(path, f"{root}/{NOTE}")) if there else None


@dataclass
class Segment(InputPartition):
    base: int
    file: str
    last: bool
    following: int | None
    low: int = 1
    high: int | None = None

    def __init__(self, base: int, file: str, following: int | None, low: int = 1, high: int | None = None) -> None:
        self.base, self.file, self.following, self.low, self.high = base, file, following, low, high
        self.last = following is None


def signed(name: str, values):
    """Unsigned 64-bit fields as bit patterns."""
    return values.view("i8") if values.dtype.itemsize == 8 else values.astype("i8" if name in ("crc", "len") else "i4")


def batches(path: str, part: Segment, names: list[str], verify: bool = True, whole: bool = False, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Accepted records of one segment in [low, high]; damage before the log's end is an error, with ``whole`` before ``high`` too."""
    index = load_index(path, part.file)
    low, high = max(0, part.low - part.base), None if part.high is None else part.high - part.base + 1
    skipped, at, end = 0, 0, None
    if index:
        records, places = index
        if part.following is not None and part.base + records != part.following:
            raise LogCorrupt(f"{part.file}: has {records} records, the next segment starts at {part.following}")
        k = min(low // STRIDE, len(places) - 1)
        skipped, at = min(k * STRIDE, records), int(places[k])
        end = int(places[min(len(places) - 1, -(-max(0, high) // STRIDE))]) if high is not None else None
    data = load(path, part.file, at, end)
    found = codec.scan(data, part.base + skipped, verify)
    n = skipped + len(found.headers)
    if part.following is not None and (found.torn or not index and part.base + n != part.following):
        raise LogCorrupt(f"{part.file}: ends after {n} records, the next segment starts at {part.following}")
    if whole and part.following is None and high is not None and n < high:
        raise LogCorrupt(f"{part.file}: ends after {n} records, {high} were there")
    first, last = max(0, low - skipped), len(found.headers) if high is None else max(0, min(n, high) - skipped)
    for a in range(first, last, rows):
        b = min(last, a + rows)
        head, off = found.headers[a:b], found.offsets[a:b]
        columns = []
        for c in names:
            if c == "payload":
                columns.append(pa.array([data[o + codec.HEADER_BYTES : o + codec.HEADER_BYTES + k] for o, k in zip(off.tolist(), head["len"].tolist(), strict=True)], pa.binary()))
            elif c == "seg_base":
                columns.append(pa.array([part.base] * (b - a), pa.int64()))
            elif c == "off":
                columns.append(pa.array(off + at))
            elif c == "rec_size":
                columns.append(pa.array(codec.HEADER_BYTES + (head["len"].astype("i8") + 7) // 8 * 8))
            else:
                columns.append(pa.array(signed(c, head[c].copy())))
        yield pa.RecordBatch.from_arrays(columns, names)


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str], verify: bool = True) -> None:
        self.path, self.names, self.verify, self.low, self.high = path, names, verify, 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on seq narrow the segments and the rows of each; all else stays with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("seq",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    high = f.value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = segments(self.path)
        out = []
        for k, (base, file) in enumerate(found):
            following = found[k + 1][0] if k + 1 < len(found) else None
            if (following is None or following > self.low) and (self.high is None or base <= self.high):
                out.append(Segment(base, file, following, self.low, self.high))
        return out or [Segment(0, "", None)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from batches(self.path, partition, self.names, self.verify)


class StreamReader(DataSourceStreamReader):
    """Offset: the next seq.  Start: ``fromSeq``, 0 for records to come only.

    ``maxRecordsPerBatch`` bounds a micro-batch.  Spark does not tell the
    source where a query stands when it asks for the newest offset; the reader
    knows it from the batches that it planned, and at first from the file
    ``progress``, of the reader's own, which such a stream must name.  That
    position may be one batch late, so the first batch after a restart may
    have twice the bound.
    """

    def __init__(self, path: str, names: list[str], options: dict) -> None:
        self.path, self.names = path, names
        options = {k.lower(): v for k, v in options.items()}
        self.start = int(options.get("fromseq", 1))
        self.most = int(options.get("maxrecordsperbatch", 0))
        self.progress = options.get("progress")
        if self.most and not self.progress:
            raise ValueError("maxRecordsPerBatch needs progress, a file in which the reader keeps its position")
        self.at: int | None = None

    def initialOffset(self) -> dict:
        if self.at is None:
            self.at = self.start or next_seq(self.path)
        return {"seq": self.at}

    def latestOffset(self) -> dict:
        newest = next_seq(self.path)
        if not self.most:
            return {"seq": newest}
        if self.at is None:
            known = self._kept()
            if known is not None:
                return {"seq": min(newest, known + 2 * self.most)}
            self.initialOffset()
        return {"seq": min(newest, self.at + self.most)}

    def _kept(self) -> int | None:
        fs, file = file_system(self.progress)
        there = fs.get_file_info(file).type == pafs.FileType.File
        return json.loads(load(self.progress, file))["seq"] if there else None

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end["seq"]
        found = segments(self.path)
        if start["seq"] < end["seq"] and found and start["seq"] < found[0][0]:
            raise NoHistory(f"{start['seq']} was retained away; the log starts at {found[0][0]}")
        bounds = [b for b, _ in found][1:] + [None]
        return [Segment(b, f, nxt, start["seq"], end["seq"] - 1) for (b, f), nxt in zip(found, bounds, strict=True) if b < end["seq"] and (nxt is None or nxt > start["seq"])]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        yield from batches(self.path, partition, self.names, whole=True)

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["seq"])
        if self.progress:
            fs, file = file_system(self.progress)
            with fs.open_output_stream(f"{file}.tmp") as out:
                out.write(json.dumps(end).encode())
            fs.move(f"{file}.tmp", file)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, int, int, list[int]]]  # base, temporary file, last seq, bytes, places of every STRIDE-th record


class Writer(DataSourceWriter):
    def __init__(self, path: str, capacity: int) -> None:
        self.path, self.capacity = path, capacity

    def write(self, rows: Iterator) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files: list[list] = []
        out, expected = None, None
        held: list[dict] = []

        def flush() -> None:
            nonlocal out
            for r, data in zip(held, codec.encode(held), strict=True):
                if len(data) > self.capacity:
                    raise ValueError("a record is larger than a segment")
                if out is None or files[-1][3] + len(data) > self.capacity:
                    close()
                    files.append([r["seq"], f"{root}/.{r['seq']:020d}-{uuid.uuid4().hex}.tmp", r["seq"], 0, []])
                    out = fs.open_output_stream(files[-1][1])
                out.write(data)
                base, _, _, used, places = files[-1]
                if (r["seq"] - base) % STRIDE == 0:
                    places.append(used)
                files[-1][2:4] = r["seq"], used + len(data)
            held.clear()

        def close() -> None:
            if out is not None:
                out.close()

        for row in rows:
            r = row.asDict()
            if expected is not None and r["seq"] != expected:
                raise ValueError(f"rows of a task must be dense in seq: {r['seq']} after {expected - 1}")
            expected = r["seq"] + 1
            held.append(r)
            if len(held) >= 4096:
                flush()
        flush()
        close()
        return Written([tuple(f) for f in files])

    def commit(self, messages: list[Written | None]) -> None:
        """Cut a torn end, check that all tasks together continue the log, then name the files."""
        fs, root = file_system(self.path)
        new = sorted(f for m in messages if m for f in m.files)
        if not new:
            return
        trim_torn_tail(self.path)
        after = next_seq(self.path) if segments(self.path) else None
        for base, _, last, _, _ in new:
            if after is not None and base != after:
                self.abort(messages)
                raise LogCorrupt(f"segment {base} does not continue the log at {after}")
            after = last + 1
        for base, tmp, last, size, places in new:
            file = f"{root}/{base:020d}{SUFFIX}"
            with fs.open_output_stream(f"{tmp}.idx") as out:
                out.write(INDEX.pack(last + 1 - base, size) + np.array(places, "<u8").tobytes())
            fs.move(f"{tmp}.idx", index_of(file))
            fs.move(tmp, file)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            for _, tmp, *_ in m.files if m else []:
                if fs.get_file_info(tmp).type == pafs.FileType.File:
                    fs.delete_file(tmp)


class SegLog(DataSource):
    """``spark.read.format("seglog").load(path)``; options: payload (true), verify (true), capacity (bytes); of streams fromSeq, maxRecordsPerBatch, progress."""

    @classmethod
    def name(cls) -> str:
        return "seglog"

    def schema(self) -> str:
        columns = SCAN_SCHEMA.split(", ")
        if str(self.options.get("payload", "true")).lower() == "false":
            columns.remove("payload binary")
        return ", ".join(columns)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema.fieldNames(), str(self.options.get("verify", "true")).lower() != "false")

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], schema.fieldNames(), self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a log is only appended to")
        return Writer(self.options["path"], int(self.options.get("capacity", CAPACITY)))


def register(spark) -> None:
    """Make the format known; filters on seq reach it only with this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegLog)


def summaries(spark, path: str):
    """SEGMENT_SCHEMA rows of every segment, each scanned by a task of its own; damage is reported, not raised."""
    from ..schema import SEGMENT_SCHEMA

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for r in batch.to_pylist():
                s = codec.scan(load(path, r["file"]), r["seg_base"])
                n = len(s.headers)
                yield pa.RecordBatch.from_pylist([{"seg_base": r["seg_base"], "records": n, "last_seq": r["seg_base"] + n - 1, "end_off": s.end, "torn": s.torn}], pa.schema([("seg_base", pa.int64()), ("records", pa.int64()), ("last_seq", pa.int64()), ("end_off", pa.int64()), ("torn", pa.bool_())]))

    rows = spark.createDataFrame(segments(path), "seg_base long, file string")
    return rows.repartition(max(1, min(1024, len(segments(path)))), "seg_base").mapInArrow(run, SEGMENT_SCHEMA)


def open_log(spark, path: str):
    """The log as a DataFrame after the recovery rules: gaps, overlaps and damage before the end refuse."""
    from ..operators.log import open_check

    bad = open_check(summaries(spark, path)).where("status <> 'ok'").limit(1).collect()
    if bad:
        raise LogCorrupt(f"segment {bad[0].seg_base}: {bad[0].status}")
    register(spark)
    return spark.read.format("seglog").load(path)


def retain(path: str, keep_from: int) -> int:
    """Delete leading segments whose successor starts at or below ``keep_from``; returns how many."""
    fs, _ = file_system(path)
    found = segments(path)
    gone = 0
    for (_, file), (following, _) in zip(found, found[1:], strict=False):
        if following > keep_from:
            break
        fs.delete_file(file)
        if fs.get_file_info(index_of(file)).type == pafs.FileType.File:
            fs.delete_file(index_of(file))
        gone += 1
    return gone


def trim_torn_tail(path: str) -> bool:
    """Rewrite the last segment without what recovery leaves out, so that the next append may follow in a new one.

    A segment of which nothing is left goes, and the one before it is the last.
    """
    found = segments(path)
    if not found:
        return False
    base, file = found[-1]
    data = load(path, file)
    s = codec.scan(data, base)
    if not s.torn:
        return False
    fs, root = file_system(path)
    if not len(s.headers):
        fs.delete_file(file)
    else:
        tmp = f"{root}/.{base:020d}-{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(tmp) as out:
            out.write(data[: s.end])
        fs.move(tmp, file)
    if fs.get_file_info(index_of(file)).type == pafs.FileType.File:
        fs.delete_file(index_of(file))
    return True
