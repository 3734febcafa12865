"""Logger bundles as a Spark data source: ``spark.read.format("bundle").load(root)``.

Channel files are planned as they lie on disk, long ones cut into byte ranges and small ones packed together, and are opened
in the task that decodes them; no content is shuffled or joined. A task reads the catalog and the lap file of a bundle beside
its channels, so samples come with their clock. The options ``runs`` and ``channels`` leave all other files unopened. They are options, not
pushed filters: Spark 4.1.2 keeps the filters that a Python source accepts with the relation, so that a second query over the same
DataFrame, with another filter or none, would read the first one's rows.
Reading works on any file system that pyarrow knows by its URI, and the same reader serves streams. The driver holds the listing.
"""

from __future__ import annotations

import re
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)

from laplens.session import ship
from laplens.sources.bundle import CHUNK, LAP_WORDS

SCHEMAS = {
    "samples": "run string, channel string, idx long, ts_us long, value double",
    "channels": "run string, channel string, ext string, n_samples long, rate_hz double, clock_us long, folder string",
    "laps": "run string, lap_no long, start_ms long, end_ms long",
    "header": "run string, section string, key string, value string, pos long",
}
TEXTS = ("DDD", "HED", "LAP")


def register_bundles(spark: SparkSession) -> None:
    """Make the format known to the session and its workers."""
    ship(spark)
    spark.dataSource.register(BundleFormat)


def read_bundles(spark: SparkSession, root: str, table: str = "samples", runs: list[str] | None = None, channels: list[str] | None = None,
                 **options) -> DataFrame:
    """A table of the bundles under ``root``. Of ``runs`` and ``channels`` given, no other run's or channel's file is opened."""
    register_bundles(spark)
    for key, names in (("runs", runs), ("channels", channels)):
        if names is not None:
            options[key] = ",".join(names)
    return spark.read.format("bundle").options(table=table, **options).load(root)


def file_system(root: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))


# -- text files of a bundle -----------------------------------------------------------------------


def ini_lines(data: bytes, first_section: str = "") -> list[tuple[str, str, str]]:
    """(section, key, value) of each ``key=value`` line."""
    out, section = [], first_section
    for line in re.split("\r?\n", data.decode("latin-1")):
        head = re.fullmatch(r"[ \t]*\[(.*)\][ \t]*", line)
        if head:
            section = head[1]
        elif line.find("=") > 0:
            key, value = line.split("=", 1)
            out.append((section, key.strip(" "), value.strip(" ")))
    return out


def hex_single(text: str) -> float:
    text = text.strip(" ").rjust(8, "0")[:8]
    return struct.unpack(">f", bytes.fromhex(text))[0] if re.fullmatch("[0-9A-Fa-f]{8}", text) else 1.0


@dataclass
class Channel:
    name: str
    ext: str
    offset: int
    scale: float
    mult: float
    signed: bool


def catalog_of(data: bytes) -> list[Channel]:
    """Channels of a catalog file, as :func:`laplens.sources.bundle.read_catalog` reads them."""
    sections: dict[str, dict[str, str]] = {}
    for section, key, value in ini_lines(data):
        if re.fullmatch("[0-9A-Fa-f]+", section):
            sections.setdefault(section, {})[key] = value
    out = []
    for lines in sections.values():
        scale, kind = lines.get("3", "").split(","), lines.get("6", "").split(",")
        name = lines.get("4", "").split(",")[0].strip(" ")
        offset = scale[0].strip()
        if name:
            out.append(Channel(name, kind[3] if len(kind) > 3 else "", int(offset) if re.fullmatch(r"[+-]?\d+", offset) else 0,
                               hex_single(scale[3]) if len(scale) > 3 else 1.0, (hex_single(scale[6]) if len(scale) > 6 else 1.0) or 1.0,
                               lines.get("6", "").startswith("FFFFFFFE") or len(kind) > 1 and kind[1] == "I"))
    return out


def laps_of(data: bytes) -> tuple[int, list[int]]:
    """Start and cumulative lap ends in ms; no laps where the file is shorter than it says."""
    words = np.frombuffer(data, "<u4", count=len(data) // 4)
    if len(words) < LAP_WORDS or words[0] > len(words) - LAP_WORDS:
        return 0, []
    return int(words[2]), words[LAP_WORDS: LAP_WORDS + int(words[0])].astype(np.int64).tolist()


# -- clock ------------------------------------------------------------------------------------------


def clock_length(n_base: int, last_ms: int, lo: int = 10, hi: int = 500, default: int = 100) -> int:
    """Microseconds that the ``n_base`` samples of the base channel last: up to the last lap end, unless that makes fewer than ``lo`` or
    more than ``hi`` samples a second; without laps they come at ``default``. The rates must divide a million."""
    rate = default if last_ms <= 0 else lo if n_base * 1000 < lo * last_ms else hi if n_base * 1000 > hi * last_ms else None
    return last_ms * 1000 if rate is None else n_base * (1_000_000 // rate)


def clock_of(idx: np.ndarray, length: int, n: int) -> np.ndarray:
    """floor(idx * length / n) without leaving 64 bits, so nothing drifts over long files."""
    whole, rest = divmod(length, n)
    return idx * whole + idx * rest // n


# -- plan and tasks ---------------------------------------------------------------------------------


@dataclass
class Bundle:
    """What a task must know of one bundle: its files by upper-case extension, with sizes."""

    run: str
    folder: str
    files: dict[str, tuple[str, int]]


@dataclass
class Piece(InputPartition):
    """Bundles with the byte ranges (extension, from, to) of their channel files to decode."""

    work: list[tuple[Bundle, list[tuple[str, int, int]]]]


class Reading:
    """Planning and decoding, for batch and stream."""

    def __init__(self, options: dict, table: str):
        self.root, self.table = options["path"], table
        self.split = max(int(options.get("splitBytes", 32 << 20)) // 2 * 2, 2)
        self.base = [c.strip().upper() for c in options.get("baseChannels", "SPEED_FRONT,SPEED").split(",")]
        self.rates = {k: int(options[k]) for k in ("lo", "hi", "default") if k in options}
        self.runs, self.channels = ({x.strip() for x in options[k].split(",")} if k in options else None for k in ("runs", "channels"))

    def listing(self) -> dict[str, tuple[Bundle, dict[str, int]]]:
        """Bundles under the root by folder, and the times of their files."""
        from pyarrow import fs

        own, root = file_system(self.root)
        found: dict[str, tuple[Bundle, dict[str, int]]] = {}
        for info in own.get_file_info(fs.FileSelector(root, recursive=True)):
            at = re.search(r"([^/]*)/([^/]+)\.MES/[^/]+\.([^./]+)$", "/" + info.path)
            if info.type == fs.FileType.File and at and (self.runs is None or at[2] in self.runs):
                bundle, times = found.setdefault(info.path.rsplit("/", 1)[0], (Bundle(at[2], at[1], {}), {}))
                bundle.files[at[3].upper()] = info.path, info.size
                times[at[3].upper()] = info.mtime_ns or 0
        return found

    def pieces(self, wanted) -> list[Piece]:
        """Work of about ``splitBytes`` each; ``wanted`` (times, ext) says which files to take. Bundles without a catalog wait."""
        out, work, held = [], [], 0
        for _, (bundle, times) in sorted(self.listing().items()):
            if self.table != "samples":
                ext = {"laps": "LAP", "header": "HED"}.get(self.table, "DDD")
                ranges = [(ext, 0, bundle.files[ext][1])] if ext in bundle.files and wanted(times, ext) else []
            else:
                ranges = [(e, at, min(at + self.split, size // 2 * 2)) for e, (_, size) in sorted(bundle.files.items())
                          if e not in TEXTS and "DDD" in bundle.files and wanted(times, e) for at in range(0, size // 2 * 2, self.split)]
            for r in ranges:
                if held and held + r[2] - r[1] > self.split:
                    out.append(Piece(work))
                    work, held = [], 0
                if not work or work[-1][0] is not bundle:
                    work.append((bundle, []))
                work[-1][1].append(r)
                held += r[2] - r[1] + 65536  # opening a file has its price, in bytes read meanwhile
        return [*out, Piece(work)] if work else out

    def rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(self.root)

        def content(path: str, start: int = 0, end: int | None = None) -> bytes:
            with own.open_input_file(path) as f:
                f.seek(start)
                return f.read() if end is None else f.read(end - start)

        for bundle, ranges in piece.work:
            text = lambda ext: content(bundle.files[ext][0]) if ext in bundle.files else b""  # noqa: B023, E731
            if self.table == "laps":
                start, ends = laps_of(text("LAP"))
                yield batch([[bundle.run] * len(ends), list(range(len(ends))), [start] * len(ends), ends], self.table)
            elif self.table == "header":
                lines = ini_lines(text("HED"), "GENERAL")
                yield batch([[bundle.run] * len(lines), *([x[i] for x in lines] for i in range(3)), list(range(len(lines)))], self.table)
            else:
                channels = [c for c in catalog_of(text("DDD")) if c.ext.upper() in bundle.files]
                count = {c.name: bundle.files[c.ext.upper()][1] // 2 for c in channels}
                by_name = {c.name.upper(): c.name for c in channels}
                base = next((by_name[b] for b in self.base if b in by_name), None)
                last = max([0, *laps_of(text("LAP"))[1]])
                length = lambda n: clock_length(count[base] if base else n, last, **self.rates)  # noqa: B023, E731
                if self.channels is not None:
                    channels = [c for c in channels if c.name in self.channels]
                if self.table == "channels":
                    n = [count[c.name] for c in channels]
                    us = [length(k) for k in n]
                    rate = [k * 1e6 / u if u else None for k, u in zip(n, us)]
                    yield batch([[bundle.run] * len(n), [c.name for c in channels], [c.ext for c in channels], n, rate, us, [bundle.folder] * len(n)], self.table)
                    continue
                for ext, start, end in ranges:
                    mine = [c for c in channels if c.ext.upper() == ext]
                    for at in range(start, end, 2 * CHUNK) if mine else ():
                        data = content(bundle.files[ext][0], at, min(at + 2 * CHUNK, end))
                        for c in mine:
                            raw = np.frombuffer(data, "<i2" if c.signed else "<u2", count=len(data) // 2).astype(np.float64)
                            idx = np.arange(at // 2, at // 2 + len(raw), dtype=np.int64)
                            yield pa.RecordBatch.from_arrays([
                                pa.repeat(bundle.run, len(raw)), pa.repeat(c.name, len(raw)), pa.array(idx),
                                pa.array(clock_of(idx, length(count[c.name]), count[c.name])), pa.array((raw - c.offset) * c.scale * c.mult)],
                                ["run", "channel", "idx", "ts_us", "value"])


_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def batch(columns: list[list], table: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in SCHEMAS[table].split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds)], list(names))


class BundleReader(DataSourceReader):
    def __init__(self, reading: Reading):
        self.reading = reading

    def partitions(self):
        return self.reading.pieces(lambda times, ext: True) or [Piece([])]

    def read(self, partition):
        yield from self.reading.rows(partition)


class BundleStream(DataSourceStreamReader):
    """Channel files in the order of their times. A file counts from when its bundle's catalog and lap file are there too, and once it has
    not changed for ``settleMs``; a file that changes later is read again."""

    def __init__(self, reading: Reading, settle_ms: int):
        self.reading, self.settle = reading, settle_ms * 1_000_000

    @staticmethod
    def ready(times: dict[str, int], ext: str) -> int:
        return max(times.get(ext, 0), times.get("DDD", 0), times.get("LAP", 0))

    def initialOffset(self):
        return {"until": 0}

    def latestOffset(self):
        now = time.time_ns() - self.settle
        times = [self.ready(times, ext) for bundle, times in self.reading.listing().values() if "DDD" in times for ext in times]
        return {"until": max([t for t in times if t <= now], default=0)}

    def partitions(self, start, end):
        return self.reading.pieces(lambda times, ext: start["until"] < self.ready(times, ext) <= end["until"])

    def read(self, partition):
        yield from self.reading.rows(partition)

    def commit(self, end):
        pass


class BundleWriter(DataSourceWriter):
    """Writes rows (path, content); of each path the last three parts are kept under the root. A file appears whole or not at all."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator):
        own, root = file_system(self.root)
        for row in iterator:
            path = root + "/" + "/".join(row["path"].split("/")[-3:])
            folder = path.rsplit("/", 1)[0]
            own.create_dir(folder, recursive=True)
            parked = f"{folder}/.{uuid.uuid4().hex}"
            with own.open_output_stream(parked) as f:
                f.write(bytes(row["content"]))
            own.move(parked, path)
        return WriterCommitMessage()


class BundleFormat(DataSource):
    """Options: ``path``; ``table`` (samples, channels, laps or header); ``runs`` and ``channels``, the only ones to read; ``splitBytes``; ``baseChannels``, the channel whose rate the laps give, by
    falling preference; ``lo``, ``hi`` and ``default`` samples a second; for streams ``settleMs``."""

    @classmethod
    def name(cls):
        return "bundle"

    def schema(self):
        return SCHEMAS[self.options.get("table", "samples")]

    def reading(self) -> Reading:
        return Reading(self.options, self.options.get("table", "samples"))

    def reader(self, schema):
        return BundleReader(self.reading())

    def streamReader(self, schema):
        return BundleStream(self.reading(), int(self.options.get("settleMs", 1000)))

    def writer(self, schema, overwrite):
        return BundleWriter(self.options)
