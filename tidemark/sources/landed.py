"""Landed delimited files as a Spark data source (S1, S2): plain files by byte ranges, zip archives by member.

One rule holds for files, archives and single lines:

* every file is read by its own header, its first line; names not asked for are never made into columns, names it lacks are NULL;
* a record is one line; blank lines are skipped, a short line leaves the rest NULL, cells beyond the header are ignored;
* a cell that begins with a quote ends at the closing quote, two quotes inside stand for one;
* a cell that then is one of NULL_WORDS is NULL.

Bytes that are not UTF-8 become replacement characters. An empty file gives no rows.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import csv as pacsv
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Words that count as a missing cell, as pandas.read_csv has them by default.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)

SPLIT_BYTES = 128 << 20  # bytes of one task; small files share a task
BLOCK_BYTES = 8 << 20  # bytes parsed at once
OPEN_COST = 1 << 20  # what opening a file counts as, in bytes

_NULLS = frozenset(NULL_WORDS)
_WILD = re.compile(r"[*?\[]")
_BOM = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Piece:
    """Lines that begin in [start, end) of a file, or of a zip's member."""

    path: str
    member: str | None
    start: int
    end: int


@dataclass
class Share(InputPartition):
    """The pieces one task reads."""

    pieces: tuple[Piece, ...]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    plain = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(plain) if "://" in plain else (pafs.LocalFileSystem(), plain)


def list_files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """Files under a folder, or those that match a pattern segment by segment; hidden names are left out."""
    wild = _WILD.search(path)
    base = path[: wild.start()].rpartition("/")[0] if wild else path
    system, root = file_system(base)
    info = system.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return system, [info]
    found = [f for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File]
    tail = path[len(base):].strip("/").split("/") if wild else None

    def fits(file: pafs.FileInfo) -> bool:
        parts = file.path[len(root.rstrip("/")):].strip("/").split("/")
        if any(p.startswith(("_", ".")) for p in parts):
            return False
        return tail is None or (len(parts) == len(tail) and all(map(fnmatchcase, parts, tail)))

    return system, sorted(filter(fits, found), key=lambda f: f.path)


def _open(system: pafs.FileSystem, path: str, member: str | None):
    """A binary stream of a whole file or member. Archives are read through their index, never as a whole."""
    if member is None:
        return io.BufferedReader(_Raw(system.open_input_file(path)), 1 << 20)
    archive = zipfile.ZipFile(_Raw(system.open_input_file(path)))
    return archive.open(member)


class _Raw(io.RawIOBase):
    """A random-access file in the form that Python's buffered readers and zipfile expect."""

    def __init__(self, source):
        self.source = source

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.source.read(len(into))
        into[: len(data)] = data
        return len(data)

    def seek(self, to: int, whence: int = 0) -> int:
        self.source.seek(to, whence)
        return self.source.tell()

    def tell(self) -> int:
        return self.source.tell()

    def close(self) -> None:
        self.source.close()
        super().close()


def cells_of(line: str, sep: str) -> list[str | None]:
    """The cells of one line, by the rule above."""
    csv.field_size_limit(2**31 - 1)
    return [None if c in _NULLS else c for c in next(csv.reader([line], delimiter=sep))]


def header_of(line: bytes, sep: str) -> list[str]:
    names = next(csv.reader([line.removeprefix(_BOM).rstrip(b"\r\n").decode("utf-8", "replace")], delimiter=sep), [])
    return [n.strip() for n in names]


def _clean(block: bytes) -> bytes:
    try:
        block.decode("utf-8")
        return block
    except UnicodeDecodeError:
        return block.decode("utf-8", "replace").encode("utf-8")


class _Lines:
    """Blocks of whole lines to record batches of the wanted columns."""

    def __init__(self, header: Sequence[str], wanted: Sequence[str], sep: str):
        self.header, self.wanted, self.sep = list(header), list(wanted), sep
        self.at = {n: i for i, n in reversed(list(enumerate(header)))}  # of equal names the first counts
        self.schema = pa.schema([(n, pa.string()) for n in wanted])

    def batches(self, block: bytes) -> Iterator[pa.RecordBatch]:
        block = _clean(block)
        odd: list[str] = []
        if b'"' in block or b"\r" in block.replace(b"\r\n", b""):
            plain = []
            for line in block.split(b"\n"):
                line = line.removesuffix(b"\r")
                (odd.append(line.decode()) if b'"' in line or b"\r" in line else plain.append(line))
            block = b"\n".join(plain) + b"\n"
        if block.strip(b"\r\n"):
            yield from self._plain(block, odd)
        if odd:
            rows = [cells_of(line, self.sep) for line in odd]
            yield pa.RecordBatch.from_arrays([pa.array(self._column(rows, n), pa.string()) for n in self.wanted], schema=self.schema)

    def _column(self, rows: list[list[str | None]], name: str) -> list[str | None]:
        i = self.at.get(name)
        return [None if i is None or i >= len(r) else r[i] for r in rows]

    def _plain(self, block: bytes, odd: list[str]) -> Iterator[pa.RecordBatch]:
        """Lines without quotes go through Arrow's parser; those with another number of cells are put aside."""

        def aside(row) -> str:
            odd.append(row.text)
            return "skip"

        places = [str(i) for i in range(len(self.header))]
        present = [n for n in self.wanted if n in self.at]
        parsed = pacsv.read_csv(
            io.BytesIO(block),
            read_options=pacsv.ReadOptions(column_names=places, use_threads=False, block_size=max(len(block) + 1, 1 << 16)),
            parse_options=pacsv.ParseOptions(delimiter=self.sep, quote_char=False, invalid_row_handler=aside),
            convert_options=pacsv.ConvertOptions(
                include_columns=[str(self.at[n]) for n in present] or places[:1], column_types={p: pa.string() for p in places},
                null_values=list(NULL_WORDS), strings_can_be_null=True,
            ),
        )
        absent = pa.nulls(parsed.num_rows, pa.string())
        held = {n: parsed.column(i).combine_chunks() for i, n in enumerate(present)}
        arrays = [held.get(n, absent) for n in self.wanted]
        if parsed.num_rows:
            yield from pa.table(arrays, schema=self.schema).to_batches(max_chunksize=50_000)


class LandedReader(DataSourceReader):
    def __init__(self, wanted: Sequence[str], options: dict):
        self.wanted = list(wanted)
        self.path, self.sep, self.member = options["path"], options.get("sep", ","), options.get("member")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.block = int(options.get("blockbytes", options.get("blockBytes", BLOCK_BYTES)))

    def _pieces(self) -> Iterator[Piece]:
        system, files = list_files(self.path)
        for f in files:
            if f.path.endswith(".zip"):
                if self.member:
                    with zipfile.ZipFile(_Raw(system.open_input_file(f.path))) as archive:
                        for m in archive.infolist():
                            if fnmatchcase(m.filename, self.member) and m.file_size:
                                yield Piece(f.path, m.filename, 0, m.file_size)
            else:
                for start in range(0, f.size, self.split):
                    yield Piece(f.path, None, start, min(start + self.split, f.size))

    def partitions(self) -> list[Share]:
        """Pieces in order, as many to a task as fit; a compressed member cannot be cut and is one piece."""
        shares, held, size = [], [], 0
        for piece in self._pieces():
            cost = piece.end - piece.start + OPEN_COST
            if held and size + cost > self.split + OPEN_COST:
                shares.append(Share(tuple(held)))
                held, size = [], 0
            held.append(piece)
            size += cost
        if held:
            shares.append(Share(tuple(held)))
        return shares or [Share(())]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(_WILD.split(self.path)[0])
        for piece in partition.pieces:
            with _open(system, piece.path, piece.member) as stream:
                yield from self._read_piece(stream, piece)

    def _read_piece(self, stream, piece: Piece) -> Iterator[pa.RecordBatch]:
        first = stream.readline()
        lines = _Lines(header_of(first, self.sep), self.wanted, self.sep)
        at = len(first)
        if piece.start > at:  # a line belongs to the range that its first byte lies in
            stream.seek(piece.start - 1)
            at = piece.start - 1 + len(stream.readline())
        while at < piece.end:
            block = stream.read(min(self.block, piece.end - at))
            if not block:
                return
            if not block.endswith(b"\n"):
                block += stream.readline()
            at += len(block)
            yield from lines.batches(block)


class LandedTable(DataSource):
    """``spark.read.format("landed_table")`` with options path, sep, member (of zips), splitBytes, blockBytes.

    Without a schema the columns are those of all headers, found by reading the first line of each file.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_table"

    def schema(self) -> T.StructType:
        reader = LandedReader([], dict(self.options))
        system, _ = file_system(_WILD.split(reader.path)[0])

        def header(piece: Piece) -> list[str]:
            with _open(system, piece.path, piece.member) as stream:
                return header_of(stream.readline(), reader.sep)

        with ThreadPoolExecutor(16) as pool:
            names = dict.fromkeys(n for h in pool.map(header, (p for p in reader._pieces() if p.start == 0)) for n in h)
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> LandedReader:
        wrong = [f.name for f in schema.fields if not isinstance(f.dataType, T.StringType)]
        if wrong:
            raise ValueError(f"landed cells are text, cast them afterwards: {', '.join(wrong)}")
        return LandedReader(schema.names, dict(self.options))


def read_landed(
    spark: SparkSession, path: str, sep: str = ",", columns: Sequence[str] | None = None, member: str | None = None,
    split_bytes: int = SPLIT_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Text columns of landed files; only ``columns`` are parsed, all headers' names if none are given."""
    spark.dataSource.register(LandedTable)
    source = spark.read.format("landed_table").option("sep", sep).option("splitBytes", split_bytes).option("blockBytes", block_bytes)
    if member is not None:
        source = source.option("member", member)
    if columns is not None:
        source = source.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return source.option("path", path).load()


def cells(line: Column, sep: str) -> Column:
    """The same cells of a line column, inside the JVM."""
    s = re.escape(sep)
    plain = F.split(line, s, -1)
    # a separator in front of every cell, so that no match is empty
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{s}("(?:[^"]++|"")*+(?:"|$)[^{s}]*+|[^{s}]*+)'), 1)
    body = '^"((?:[^"]++|"")*+)'

    def bare(cell: Column) -> Column:
        inside = F.replace(F.regexp_extract(cell, body, 1), F.lit('""'), F.lit('"'))
        return F.when(cell.startswith('"'), F.concat(inside, F.regexp_extract(cell, body + '"(.*)$', 2))).otherwise(cell)

    all_cells = F.when(F.contains(line, F.lit('"')), F.transform(quoted, bare)).otherwise(plain)
    return F.transform(all_cells, lambda c: F.when(~c.isin(*NULL_WORDS), c))
