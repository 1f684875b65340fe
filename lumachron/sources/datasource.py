"""Spark data sources for light curves: text files and FITS binary tables.

    spark.dataSource.register(LightCurves); spark.read.format("lightcurve").load(folder)
    spark.dataSource.register(FitsTables); spark.read.format("fits_table").option("columns", "TIME,SAP_FLUX").load(folder)

Files are planned in ranges, of bytes for text and of rows for tables, so a large file is read by many tasks; the option `series` (names of
files without their endings) leaves out the other files before they are opened. It is an option and no pushed filter, as a filter that a Python source
takes stays with its relation, and so with other queries of the same DataFrame. FITS tables are those of the standard: header cards in
blocks of 2,880 bytes, big-endian columns, TNULL, TSCAL and TZERO. Paths are those of pyarrow's file systems. Light curves are written by a
file a task into a folder of their own, which is renamed into place when all tasks are done.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

RANGE_BYTES = 32 << 20
BLOCK, CARD = 2880, 80
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|infinity|nan)", re.IGNORECASE)


class BadFile(ValueError):
    """A file that isn't what its format asks for; the message names it."""


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str, endings: tuple[str, ...]) -> list[str]:
    system, at = located(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(endings) and not f.base_name.startswith(("_", ".")) and "/_" not in f.path.removeprefix(at))


def series_of(path: str) -> str:
    """The name of a file without its endings."""
    return re.sub(r"(\.(dat|txt|fits|fit))+$", "", path.rsplit("/", 1)[-1], flags=re.IGNORECASE)


class BySeries(DataSourceReader):
    """A reader of a folder's files, or of those that the option `series` names, comma-separated."""

    path: str
    endings: tuple[str, ...]
    series: str | None

    def files(self) -> list[str]:
        wanted = None if self.series is None else {s.strip() for s in self.series.split(",")}
        return [f for f in files_of(self.path, self.endings) if wanted is None or series_of(f) in wanted]


# text


@dataclass
class TextRange(InputPartition):
    file: str
    start: int
    end: int
    columns: int


class LightCurveReader(BySeries):
    """Rows of series_id, time, mag, mag_err. A file has the columns of its first line, 2 or 3; a line with fewer, or with a value that is no number or NaN,
    is left out, one with more is an error."""

    endings = (".dat", ".txt")

    def __init__(self, options: dict):
        self.path, self.series, self.size = options["path"], options.get("series"), int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, _ = located(self.path)
        out = []
        for file in self.files():
            with system.open_input_file(file) as f:
                size = f.size()
                first = next((t for t in map(tokens, lines(f, 0, size)) if t), None)
            if first is None:
                continue
            if len(first) not in (2, 3):
                raise BadFile(f"{file}: expected 2 or 3 columns")
            out += [TextRange(file, a, min(size, a + self.size), len(first)) for a in range(0, size, self.size)]
        return out

    def read(self, part: TextRange) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        names, columns = series_of(part.file), [[], [], []]

        def batch() -> pa.RecordBatch:
            data = [pa.array([names] * len(columns[0]), pa.string()), *(pa.array(c, pa.float64()) for c in columns)]
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays(data, ["series_id", "time", "mag", "mag_err"])

        with system.open_input_file(part.file) as f:
            for line in lines(f, part.start, part.end):
                own = tokens(line)
                if len(own) > part.columns:
                    raise BadFile(f"{part.file}: expected {part.columns} columns")
                numbers = [float(t) if NUMBER.fullmatch(t) else None for t in own]
                if len(own) == part.columns and all(x is not None and x == x for x in numbers):
                    for c, x in zip(columns, [*numbers, None]):
                        c.append(x)
                if len(columns[0]) == 65_536:
                    yield batch()
        if columns[0]:
            yield batch()


def lines(f: pa.NativeFile, start: int, end: int) -> Iterator[str]:
    """Lines that begin in [start, end) of a file."""
    at = max(0, start - 1)  # a line begins at start if the byte before ends one
    f.seek(at)
    inside, held = start == 0, b""
    while at < end or not inside:
        chunk = f.read(1 << 16)
        *whole, held = (held + chunk).split(b"\n")
        for line in whole if chunk else [held] if held else []:
            if inside and at < end:
                yield line.decode("utf-8", "replace")
            inside = True
            at += len(line) + 1
        if not chunk:
            return


def tokens(line: str) -> list[str]:
    return line.split("#", 1)[0].split()


class LightCurveWriter(DataSourceWriter):
    """A file a series and task, lines in the order of rows; nothing is seen under the path until all tasks are done, and nothing is left of a job that failed."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.scratch = f"{located(self.path)[1].rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, _ = located(self.path)
        folder, open_ = f"{self.scratch}/{uuid.uuid4().hex}", {}
        system.create_dir(folder)
        try:
            for series, time, mag, error in rows:
                if series not in open_:
                    if series is None or "/" in series or series.startswith(("_", ".")):
                        raise BadFile(f"{series}: not a name for a file")
                    open_[series] = system.open_output_stream(f"{folder}/{series}.dat")
                open_[series].write((f"{time:.8f} {mag:.6f}" + ("" if error is None else f" {error:.6f}") + "\n").encode())
        finally:
            for f in open_.values():
                f.close()
        message = WriterCommitMessage()
        message.files = [f"{folder}/{s}.dat" for s in open_]
        return message

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.path)
        root = root.rstrip("/")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.File:
                    system.delete_file(old.path)
        for k, message in enumerate(messages):
            for file in message.files if message else []:
                if len(messages) > 1:  # tasks may have rows of one series
                    system.create_dir(f"{root}/{k}")
                system.move(file, f"{root}/{k if len(messages) > 1 else ''}/{file.rsplit('/', 1)[-1]}")
        system.delete_dir(self.scratch)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = located(self.path)
        if system.get_file_info(self.scratch).type == fs.FileType.Directory:
            system.delete_dir(self.scratch)


class LightCurves(DataSource):
    """Format lightcurve: series_id, time, mag, mag_err of text files."""

    @classmethod
    def name(cls) -> str:
        return "lightcurve"

    def schema(self) -> str:
        return "series_id string, time double, mag double, mag_err double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LightCurveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return LightCurveWriter(self.options, overwrite)


# FITS binary tables

#: Letters of TFORM: numpy kind, Spark type.
FORMS: dict[str, tuple[str, DataType]] = {"L": ("u1", BooleanType()), "B": ("u1", IntegerType()), "I": (">i2", IntegerType()), "J": (">i4", IntegerType()), "K": (">i8", LongType()), "E": (">f4", DoubleType()), "D": (">f8", DoubleType()), "A": ("S", StringType())}


@dataclass
class Column:
    name: str
    letter: str
    repeat: int
    null: int | None
    scale: float
    zero: float

    @property
    def dtype(self) -> tuple:
        kind = FORMS[self.letter][0]
        return (f"S{self.repeat}",) if self.letter == "A" else (kind,) if self.repeat == 1 else (kind, (self.repeat,))

    @property
    def scaled(self) -> bool:
        return self.scale != 1 or self.zero != 0

    @property
    def kind(self) -> DataType:
        one = DoubleType() if self.scaled else FORMS[self.letter][1]
        return ArrayType(one) if self.repeat != 1 and self.letter != "A" else one

    def values(self, raw: np.ndarray) -> pa.Array:
        if self.letter == "A":
            return pa.array([x.rstrip(b" \0").decode("ascii", "replace") for x in raw.tolist()], pa.string())
        flat = raw.reshape(-1)
        none = np.zeros(len(flat), bool) if self.null is None else flat == self.null
        if self.letter == "L":
            found = pa.array(flat == ord("T"), pa.bool_(), mask=flat == 0)
        elif self.scaled or self.letter in "ED":
            found = pa.array(flat.astype(np.float64) * self.scale + self.zero, pa.float64(), mask=none)
        else:
            found = pa.array(flat.astype(np.int64), pa.int64(), mask=none).cast(pa.int64() if self.letter == "K" else pa.int32())
        return found if self.repeat == 1 else pa.FixedSizeListArray.from_arrays(found, self.repeat).cast(pa.list_(found.type))


def header(f: pa.NativeFile, file: str) -> dict[str, str | int | float | bool]:
    """Cards of the header that begins here, up to END; the file stands behind its last block."""
    cards: dict[str, str | int | float | bool] = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise BadFile(f"{file}: truncated header")
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] != "= ":
                continue
            value = card[10:].strip()
            if value.startswith("'"):
                cards[key] = re.match(r"'((?:[^']|'')*)'", value)[1].replace("''", "'").rstrip()
            elif (bare := value.split("/", 1)[0].strip()) in ("T", "F"):
                cards[key] = bare == "T"
            elif bare:
                cards[key] = float(bare.replace("D", "E")) if re.search("[.ED]", bare) else int(bare)


def table_of(system: fs.FileSystem, file: str, number: int) -> tuple[list[Column], int, int, int]:
    """Columns, bytes a row, rows, and where the rows begin, of a file's n-th binary table (from 1)."""
    with system.open_input_file(file) as f:
        size, at, seen = f.size(), 0, 0
        while at < size:
            f.seek(at)
            cards = header(f, file)
            begins = f.tell()
            axes = [int(cards.get(f"NAXIS{k}", 0)) for k in range(1, int(cards.get("NAXIS", 0)) + 1)]
            length = abs(int(cards.get("BITPIX", 8))) // 8 * (int(np.prod(axes)) if axes else 0) + int(cards.get("PCOUNT", 0))
            if cards.get("XTENSION") == "BINTABLE":
                seen += 1
                if seen == number:
                    if size < begins + axes[0] * axes[1]:
                        raise BadFile(f"{file}: truncated table")
                    columns = []
                    for k in range(1, int(cards["TFIELDS"]) + 1):
                        form = re.match(r"(\d*)([A-Z])", str(cards[f"TFORM{k}"]))
                        if form[2] not in FORMS:
                            raise BadFile(f"{file}: column format {cards[f'TFORM{k}']}")
                        columns.append(Column(str(cards.get(f"TTYPE{k}", f"col{k}")), form[2], int(form[1] or 1), cards.get(f"TNULL{k}"), float(cards.get(f"TSCAL{k}", 1)), float(cards.get(f"TZERO{k}", 0))))
                    return columns, axes[0], axes[1], begins
            at = begins + -(-length // BLOCK) * BLOCK
    raise BadFile(f"{file}: no binary table {number}")


@dataclass
class TableRange(InputPartition):
    file: str
    first: int
    last: int


class FitsReader(BySeries):
    endings = (".fits", ".fit")

    def __init__(self, options: dict, schema: StructType):
        self.path, self.series = options["path"], options.get("series")
        self.number, self.size = int(options.get("table", 1)), int(options.get("rangeBytes", RANGE_BYTES))
        self.names = [f.name for f in schema if f.name != "series_id"]

    def partitions(self) -> list[InputPartition]:
        system, _ = located(self.path)
        out = []
        for file in self.files():
            _, width, rows, _ = table_of(system, file, self.number)
            many = max(1, self.size // width)
            out += [TableRange(file, a, min(rows, a + many)) for a in range(0, rows, many)]
        return out

    def read(self, part: TableRange) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        columns, width, _, begins = table_of(system, part.file, self.number)
        by_name = {c.name: c for c in columns}
        missing = [n for n in self.names if n not in by_name]
        if missing:
            raise BadFile(f"{part.file}: no column {missing[0]}")
        dtype = np.dtype([(c.name, *c.dtype) for c in columns])
        if dtype.itemsize != width:
            raise BadFile(f"{part.file}: rows of {width} bytes, columns of {dtype.itemsize}")
        with system.open_input_file(part.file) as f:
            for a in range(part.first, part.last, 65_536):
                n = min(part.last, a + 65_536) - a
                f.seek(begins + a * width)
                raw = np.frombuffer(f.read(n * width), dtype)
                data = [by_name[c].values(raw[c]) for c in self.names]
                yield pa.RecordBatch.from_arrays([pa.array([series_of(part.file)] * n, pa.string()), *data], ["series_id", *self.names])


class FitsTables(DataSource):
    """Format fits_table: series_id and the columns of a binary table (option table, from 1; option columns: those wanted, all if unset). All files have the
    columns of the first; an empty folder has series_id alone."""

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> StructType:
        system, _ = located(self.options["path"])
        files = files_of(self.options["path"], FitsReader.endings)
        columns = table_of(system, files[0], int(self.options.get("table", 1)))[0] if files else []
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        named = {c.name: c for c in columns}
        if unknown := [w for w in wanted if files and w not in named]:
            raise BadFile(f"{files[0]}: no column {unknown[0]}")
        chosen = [named[w] for w in wanted if w in named] if wanted else columns
        return StructType([StructField("series_id", StringType()), *(StructField(c.name, c.kind) for c in chosen)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FitsReader(self.options, schema)
