"""The data source "fastx": reads of FASTA and FASTQ files.

Options: ``format`` (fasta or fastq), ``compression`` (none, gzip or auto by the
file's first bytes), ``mode`` (compat or strict), ``k`` and ``piece_len`` (cut long
records into pieces with k - 1 bases in common), ``split_bytes``.

A line ends at \\n, \\r or \\r\\n.  In FASTA a line that begins with ``>`` is a header
and the lines up to the next such line are the read; in compat mode the line
right after a header always belongs to the read, even if it begins with ``>``.
In FASTQ a line is a read if the line before begins with ``@`` and the one after
with ``+``.

Plain files are read in ranges of split_bytes by many tasks; short ranges in a row share a
task of about TASK bytes.  Without k a range takes the records that begin in it.  With k a
FASTA range takes the windows of k signs that start in it, wherever their record began, so
that one long record, even of a single line, is read by many tasks in pieces of bounded
size; in parts behind the first the header is null and the offset is where the range
begins.  A gzip file is one task.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

SCHEMA = "file string, offset long, piece long, header string, seq string"
BLOCK = 1 << 20
#: Bytes of the first read at a place; the next ones double up to BLOCK, so that a short range reads little.
FIRST = 1 << 12
#: Bytes that a task reads where ranges are shorter.  A task costs as much as thousands of short ranges.
TASK = 2 << 20


_END = re.compile(rb"\r\n?|\n")


def parts_of(stream, at: int = 0, line: int | None = None) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(offset of the line, offset of the part, bytes, line end or None if the line goes on): lines in
    parts of at most a block.  Each byte is looked at once.  line: the start of the line that `at` lies in."""
    line = at if line is None else line
    inside, held, ended, size = line < at, b"", False, FIRST
    while not ended:
        block, size = stream.read(min(size, BLOCK)), 2 * size
        ended = not block
        block, held = held + block, b""
        if not ended and block.endswith(b"\r"):
            block, held = block[:-1], b"\r"  # the next block may begin with \n
        start = 0
        for end in _END.finditer(block):
            yield line, at + start, block[start : end.start()], end[0]
            start, inside, line = end.end(), False, at + end.end()
        if start < len(block):
            yield line, at + start, block[start:], None
            inside = True
        at += len(block)
    if inside:
        yield line, at, b"", b""


def lines_of(stream, at: int = 0) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, line, line end) of a byte stream."""
    held: list[bytes] = []
    for offset, _, data, end in parts_of(stream, at):
        held.append(data)
        if end is not None:
            yield offset, b"".join(held), end
            held = []


def line_start(stream, at: int) -> int:
    """The start of the line that holds the byte at `at`."""
    (start, known), size = getattr(stream, "line", (0, 0)), FIRST
    while not start <= at <= known:
        low = max(0, at - min(size, BLOCK), known if known < at else 0)
        stream.seek(low)
        block = stream.read(at - low)
        found = max(block.rfind(b"\n"), block.rfind(b"\r"))
        if found >= 0:
            return low + found + 1
        if not low:
            return 0
        at, size = low, 2 * size
    return start


def _byte(stream, at: int) -> bytes:
    stream.seek(at)
    return stream.read(1)


def _before(stream, start: int) -> int:
    """The start of the line before the one that starts there."""
    end = start - 1
    if end and _byte(stream, end) == b"\n" and _byte(stream, end - 1) == b"\r":
        end -= 1
    return line_start(stream, end)


def is_header(stream, start: int, strict: bool) -> bool:
    """Whether the line that starts there is a header: of lines in a row that begin with ``>``
    every other one is, unless strict."""
    if _byte(stream, start) != b">":
        return False
    before = 0
    while not strict and start and _byte(stream, start := _before(stream, start)) == b">":
        before += 1
    return before % 2 == 0


def _after_header(stream, start: int) -> bool:
    """Whether any header stands before the line that starts there."""
    searched, headed = getattr(stream, "searched", (0, False))
    if searched > start:
        searched, headed = 0, False
    if not headed:
        stream.seek(searched)
        headed = any(line == at and data[:1] == b">" for line, at, data, _ in parts_of(_Limited(stream, start - searched), searched))
    if isinstance(stream, Held):
        stream.searched = start, headed
    return headed


def fasta_windows(stream, begin: int, stop: int | None, k: int, piece_len: int, strict: bool = False) -> Iterator[tuple[int, int, bytes | None, bytes]]:
    """(offset, number, header, piece): pieces in which each window of k signs (line breaks don't count)
    that starts in [begin, stop) occurs once.  A record that begins in the range has a piece 0."""
    if begin and _byte(stream, begin) == b"\n" and _byte(stream, begin - 1) == b"\r":
        begin += 1
    start = line_start(stream, begin)
    held = stream if isinstance(stream, Held) else None
    if held and held.state and held.line[0] == start:
        marked, going, after = held.state
    else:
        marked = is_header(stream, start, strict)
        # Whether a read goes on here, and whether its first line is one that looks like a header.
        going = begin > 0 and not marked and _after_header(stream, start)
        after = going and _byte(stream, start) == b">"
    if held:
        held.line, held.state = (start, begin), (marked, going, after)
    offset, number, header, title, late = begin, 1, None, [], 0
    pieces, in_header = Cutter(k, piece_len, False), False
    stop = float("inf") if stop is None else stop
    if start < begin:  # what the line has before the range is not needed
        in_header, after = marked, False
    stream.seek(begin)
    for line, at, data, end in parts_of(stream, begin, start):
        if line == at:
            in_header, after = data[:1] == b">" and not after, False
            if in_header or not going and line >= stop:
                for piece in pieces.finish() if going else ():
                    yield offset, number, header, piece
                    number += 1
                if line >= stop:
                    return
                going, title = False, []
        if in_header:
            title.append(data)
            if end is not None:
                begun = line >= begin
                going, after, late = True, not strict, 0
                offset, number, header = (line, 0, b"".join(title)[1:]) if begun else (begin, 1, None)
                pieces = Cutter(k, piece_len, begun)
        elif going:
            own = data[max(0, begin - at) : max(0, stop - at) if stop < at + len(data) else None]
            more = data[max(0, stop - at) :][: k - 1 - late] if stop < at + len(data) else b""
            late += len(more)
            for piece in pieces.add(own + more):
                yield offset, number, header, piece
                number += 1
            if at + len(data) > stop and late >= k - 1:
                break
    for piece in pieces.finish() if going else ():
        yield offset, number, header, piece
        number += 1


def fasta_records(lines: Iterator[tuple[int, bytes, bytes]], strict: bool = False, begin: int = 0, stop: int | None = None) -> Iterator[tuple[int, bytes, Iterator[bytes]]]:
    """(offset, header, parts of the read), from the first plain header at or after begin up to that of stop.

    A header is plain if the line before it does not begin with ``>``.  What follows
    it doesn't depend on earlier lines, so neighbouring ranges agree on the border.
    """
    marked, row = False, next(lines, None)
    while row is not None and (marked or row[0] < begin or row[1][:1] != b">"):
        marked, row = row[1][:1] == b">", next(lines, None)
    while row is not None and not (stop is not None and row[0] >= stop and not marked):
        after: list = [True, None]  # whether the last line begins with ">", and the next header

        def body(after=after) -> Iterator[bytes]:
            end, first = b"", not strict
            for line in lines:
                if line[1][:1] == b">" and not first:
                    after[1] = line
                    return
                after[0], first = line[1][:1] == b">", False
                yield end + line[1]
                end = line[2]

        parts = body()
        yield row[0], row[1][1:], parts
        for _ in parts:
            pass
        marked, row = after


def fastq_records(lines: Iterator[tuple[int, bytes, bytes]], begin: int = 0, stop: int | None = None) -> Iterator[tuple[int, bytes, Iterator[bytes]]]:
    """(offset, header, the read) where the read's line starts in [begin, stop)."""
    two, one = None, None
    for row in lines:
        if two is not None and two[1][:1] == b"@" and row[1][:1] == b"+" and one[0] >= begin and (stop is None or one[0] < stop):
            yield one[0], two[1][1:], iter([one[1]])
        if stop is not None and one is not None and one[0] >= stop:
            return
        two, one = one, row


class Cutter:
    """Cuts what is added into pieces of at most `size` signs in which each window of k occurs once.
    A read that begins here has a piece even if it is shorter than k."""

    def __init__(self, k: int, size: int, begins: bool = True):
        self.k, self.size, self.owed = k, max(size, 2 * k), begins
        self.held, self.n = [], 0

    def add(self, data: bytes) -> Iterator[bytes]:
        self.held.append(data)
        self.n += len(data)
        if self.n > self.size + (1 << 16):
            yield from self._full()

    def _full(self) -> Iterator[bytes]:
        held, at = b"".join(self.held), 0
        while len(held) - at > self.size:
            yield held[at : at + self.size]
            at, self.owed = at + self.size - self.k + 1, False
        self.held = [held[at:]]
        self.n = len(held) - at

    def finish(self) -> Iterator[bytes]:
        yield from self._full()
        if self.owed or self.n >= self.k:
            yield self.held[0]


def cut(parts: Iterator[bytes], k: int | None, piece_len: int) -> Iterator[bytes]:
    """A read whole, or in pieces of at most piece_len bases in which each window of k occurs once."""
    if not k:
        yield b"".join(parts)
        return
    pieces = Cutter(k, piece_len)
    for part in parts:
        yield from pieces.add(part.translate(None, b"\r\n"))
    yield from pieces.finish()


def _back_to_line(stream, at: int) -> int:
    """The start of the line before the one that `at` lies in (0 if there is none)."""
    if _byte(stream, at) == b"\n" and _byte(stream, at - 1) == b"\r":
        at -= 1
    start = line_start(stream, at)
    return _before(stream, start) if start else 0


class _Limited:
    def __init__(self, stream, size: int):
        self.stream, self.left = stream, size

    def read(self, n: int) -> bytes:
        data = self.stream.read(min(n, self.left))
        self.left -= len(data)
        return data


class Held:
    """A file of which the last block is held, with what earlier ranges found, so that short ranges
    in a row read each byte about once."""

    def __init__(self, stream):
        self.stream, self.at, self.low, self.data = stream, 0, 0, b""
        self.line = 0, 0  # the start of a line, and up to where it is known to go on
        self.state = None  # what is known of that line: marked, going and after of fasta_windows
        self.searched = 0, False  # the start of a line, and whether a header stands before it

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        if self.at < self.low:  # a look back leaves the block as it is
            self.stream.seek(self.at)
            data = self.stream.read(n)
            self.at += len(data)
            return data
        if self.at + n > self.low + len(self.data):
            self.low = max(0, self.at - FIRST)
            self.stream.seek(self.low)
            self.data = self.stream.read(self.at - self.low + max(n, BLOCK))
        data = self.data[self.at - self.low : self.at - self.low + n]
        self.at += len(data)
        return data


class FileRange(InputPartition):
    """Ranges in a row of one file: where each begins, and where the last ends."""

    def __init__(self, path: str, begins: range, stop: int | None, packed: bool):
        self.path, self.begins, self.stop, self.packed = path, begins, stop, packed


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.format = options.get("format", "fasta").lower()
        if self.format not in ("fasta", "fastq"):
            raise ValueError("format must be fasta or fastq")
        self.compression = options.get("compression", "auto").lower()
        if self.compression not in ("none", "gzip", "auto"):
            raise ValueError("compression must be none, gzip or auto")
        self.strict = {"compat": False, "strict": True}[options.get("mode", "compat").lower()]
        self.k = int(options["k"]) if options.get("k") else None
        self.piece_len = int(options.get("piece_len", 1000))
        self.split = int(options.get("split_bytes", 64 << 20))

    def partitions(self) -> list[FileRange]:
        out = []
        for path in (f for p in self.options["path"].split(",") for f in files.listed(p)):
            packed = self.compression == "gzip"
            if self.compression == "auto":
                with files.opened(path) as f:
                    packed = f.read(2) == b"\x1f\x8b"
            size = files.size(path)
            if packed or size <= self.split:
                out.append(FileRange(path, range(1), None, packed))
            else:
                begins, n = range(0, size, self.split), max(1, TASK // self.split)
                out += [FileRange(path, begins[i : i + n], begins[i + n] if i + n < len(begins) else None, False) for i in range(0, len(begins), n)]
        return out

    def read(self, partition: FileRange) -> Iterator[tuple]:
        with files.opened(partition.path) as stream:
            if partition.packed:
                stream = gzip.open(stream)  # members in a row are read on, a cut-off one raises
            for offset, number, header, seq in self._pieces(stream, partition.begins, partition.stop):
                yield partition.path, offset, number, None if header is None else header.decode("utf-8", "replace"), seq.decode("latin-1")

    def _pieces(self, stream, begins: range, stop: int | None) -> Iterator[tuple[int, int, bytes | None, bytes]]:
        if self.k and self.format == "fasta":
            stream = Held(stream) if len(begins) > 1 else stream
            for begin, end in zip(begins, [*begins[1:], stop]):
                yield from fasta_windows(stream, begin, end, self.k, self.piece_len, self.strict)
            return
        begin = begins[0]  # the records of ranges in a row are those of one range
        at = _back_to_line(stream, begin) if begin else 0
        if begin:
            stream.seek(at)
        lines = lines_of(stream, at)
        records = fasta_records(lines, self.strict, begin, stop) if self.format == "fasta" else fastq_records(lines, begin, stop)
        for offset, header, parts in records:
            for number, seq in enumerate(cut(parts, self.k, self.piece_len)):
                yield offset, number, header, seq


class FastxSource(DataSource):
    """spark.read.format("fastx").option("format", "fastq").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(dict(self.options))


def read_reads(spark: SparkSession, paths: str | list[str], format: str = "fasta", compression: str = "auto", mode: str = "compat", k: int | None = None, piece_len: int = 1000, split_bytes: int = 64 << 20) -> DataFrame:
    """Reads of files, folders and patterns: file, offset, piece, header, seq.

    Bytes outside ASCII become one sign each; none is a base.
    """
    spark.dataSource.register(FastxSource)
    reader = spark.read.format("fastx").option("format", format).option("compression", compression).option("mode", mode)
    reader = reader.option("piece_len", piece_len).option("split_bytes", split_bytes)
    if k:
        reader = reader.option("k", k)
    return reader.load(paths if isinstance(paths, str) else ",".join(paths))
