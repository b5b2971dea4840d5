"""Containers of forms as DataFrames: what a file is, its entries and streams, and ZIP files made from rows.

Parsers work on one file's bytes at a time inside Arrow batches; a damaged file gives a row
with an error and never stops a job.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signatures, and the layout of compound files and record headers.
COMPOUND = bytes.fromhex("d0cf11e0a1b11ae1")
FREE, END_OF_CHAIN, NO_STREAM = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFF
FORM_SIGNATURE = b"HWP Document File"
FLAGS = ["compressed", "password", "distribution", "script", "drm", "xml_template", "history", "signature", "certificate_encrypted", "signature_spare", "certificate_drm", "ccl", "mobile", "privacy", "tracking", "kogl", "video_control", "toc_field"]


class Damaged(ValueError):
    """A file that breaks its format."""


def kind_of(content: Column) -> Column:
    """compound, zip, old_form, pdf or unknown, by the first bytes."""
    head = lambda b: F.substring(content, 1, len(b)) == F.lit(b)
    return F.when(head(COMPOUND) & (F.octet_length(content) >= 512), "compound").when(head(b"PK\x03\x04"), "zip").when(head(b"HWP Document File V3.00"), "old_form").when(head(b"%PDF"), "pdf").otherwise("unknown")


def read_files(spark: SparkSession, path: str, glob: str = "*.{hwp,hwpx}") -> DataFrame:
    """(path, length, content, kind) of the files of a folder, not of those below it."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(path)
    return got.select("path", "length", "content").withColumn("kind", kind_of(F.col("content")))


class CompoundFile:
    """Streams of a compound file: header, sector tables, directory, small streams; loops and bounds are checked."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 512 or not data.startswith(COMPOUND):
            raise Damaged("no compound file")
        self.data = data
        shift, small_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or small_shift != 6:
            raise Damaged("sector sizes")
        self.size = 1 << shift
        tables, directory, _, self.cutoff, small_table, _, more, _ = struct.unpack_from("<8I", data, 44)
        listed = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while more not in (END_OF_CHAIN, FREE):
            if more in seen:
                raise Damaged("a loop in the sector list")
            seen.add(more)
            *part, more = struct.unpack(f"<{self.size // 4}I", self.sector(more))
            listed += part
        self.next = [n for s in listed[:tables] if s not in (FREE, END_OF_CHAIN) for n in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        raw = b"".join(self.sector(s) for s in self.chain(directory, self.next))
        self.entries = [self.entry(raw[i : i + 128]) for i in range(0, len(raw) - 127, 128)]
        if not self.entries:
            raise Damaged("no directory")
        small = b"".join(self.sector(s) for s in self.chain(small_table, self.next))
        self.small_next = list(struct.unpack(f"<{len(small) // 4}I", small))
        self.small = b"".join(self.sector(s) for s in self.chain(self.entries[0][5], self.next))

    def sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if at + self.size > len(self.data) + self.size - 1 or at >= len(self.data):
            raise Damaged(f"sector {n} is past the end")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    @staticmethod
    def chain(first: int, table: list[int]) -> Iterator[int]:
        seen = set()
        while first not in (END_OF_CHAIN, FREE):
            if first in seen or first >= len(table):
                raise Damaged("a broken chain")
            seen.add(first)
            yield first
            first = table[first]

    @staticmethod
    def entry(raw: bytes) -> tuple[str, int, int, int, int, int, int]:
        """(name, kind, left, right, child, first sector, size)."""
        length = struct.unpack_from("<H", raw, 64)[0]
        name = raw[: max(length - 2, 0)].decode("utf-16-le", "replace")
        left, right, child = struct.unpack_from("<3I", raw, 68)
        first, size = struct.unpack_from("<IQ", raw, 116)
        return name, raw[66], left, right, child, first, size

    def streams(self) -> Iterator[tuple[str, bytes]]:
        """(path, bytes) of every stream, by walking the tree of each storage."""
        todo, seen = [(self.entries[0][4], "")], set()
        while todo:
            n, top = todo.pop()
            if n == NO_STREAM:
                continue
            if n in seen or n >= len(self.entries):
                raise Damaged("a broken directory")
            seen.add(n)
            name, kind, left, right, child, first, size = self.entries[n]
            todo += [(left, top), (right, top)]
            if kind == 1:
                todo.append((child, f"{top}{name}/"))
            elif kind == 2:
                yield top + name, self.content(first, size)

    def content(self, first: int, size: int) -> bytes:
        size &= 0xFFFFFFFF if self.size == 512 else ~0
        if size >= self.cutoff:
            return b"".join(self.sector(s) for s in self.chain(first, self.next))[:size]
        return b"".join(self.small[s * 64 : s * 64 + 64] for s in self.chain(first, self.small_next))[:size] if size else b""


def inflate(data: bytes) -> tuple[bytes, int]:
    """A raw DEFLATE stream and how many bytes of ``data`` it took."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data) + d.flush()
    except zlib.error as e:
        raise Damaged(str(e)) from e
    if not d.eof:
        raise Damaged("the stream is cut off")
    return out, len(data) - len(d.unused_data)


def decode_stream(data: bytes, compressed: bool) -> bytes:
    """A stream's bytes. After compressed ones nothing may stand but their CRC-32 and size."""
    if not compressed:
        return data
    out, took = inflate(data)
    rest = data[took:]
    if rest and rest != struct.pack("<II", zlib.crc32(out), len(out)):
        raise Damaged("the trailer does not fit the stream")
    return out


def encode_stream(data: bytes, compressed: bool, trailer: bool) -> bytes:
    if not compressed:
        return data
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush() + (struct.pack("<II", zlib.crc32(data), len(data)) if trailer else b"")


def file_header(data: bytes) -> dict[str, object]:
    """version and flags of a form's header stream."""
    if len(data) < 40 or not data.startswith(FORM_SIGNATURE):
        raise Damaged("no form header")
    build, revision, minor, major = data[32:36]
    flags = struct.unpack_from("<I", data, 36)[0]
    return {"version": f"{major}.{minor}.{revision}.{build}", **{name: bool(flags >> i & 1) for i, name in enumerate(FLAGS)}}


def split_records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, body) of a record stream; a size of 4095 says that the size follows."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise Damaged("a cut record header")
        head = struct.unpack_from("<I", data, at)[0]
        at, size = at + 4, head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                raise Damaged("a cut record header")
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        if at + size > len(data):
            raise Damaged("a cut record")
        yield head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size]
        at += size


def join_records(records: list[tuple[int, int, bytes]]) -> bytes:
    out = []
    for tag, level, body in records:
        big = len(body) >= 0xFFF
        out.append(struct.pack("<I", tag | level << 10 | (0xFFF if big else len(body)) << 20) + (struct.pack("<I", len(body)) if big else b"") + body)
    return b"".join(out)


def entries_of(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of a container's entries; ZIP entries are checked against their CRC."""
    if content.startswith(COMPOUND):
        yield from CompoundFile(content).streams()
        return
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if info.flag_bits & 1:
                    raise Damaged("an encrypted entry")
                if not info.is_dir():
                    yield info.filename, z.read(info)
    except (zipfile.BadZipFile, NotImplementedError, zlib.error) as e:
        raise Damaged(str(e)) from e


def entries(files: DataFrame) -> DataFrame:
    """(path, entry, content, error) of every entry of ``files`` (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(path, n, b, None) for n, b in entries_of(bytes(content))]
                except (Damaged, struct.error) as e:
                    rows = [(path, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "entry", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, entry string, content binary, error string")


def sections(found: DataFrame) -> DataFrame:
    """Section entries with their number, so that Section10 comes after Section9."""
    number = F.regexp_extract("entry", r"[Ss]ection(\d+)(?:\.xml)?$", 1)
    return found.where(number != "").withColumn("section", number.cast("int"))


def records(streams: DataFrame, compressed: bool = True) -> DataFrame:
    """(path, entry, ord, tag, level, body, error) of the record streams in ``streams`` (path, entry, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, entry, content in zip(frame["path"], frame["entry"], frame["content"], strict=True):
                try:
                    rows = [(path, entry, i, *r, None) for i, r in enumerate(split_records(decode_stream(bytes(content), compressed)))]
                except Damaged as e:
                    rows = [(path, entry, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "entry", "ord", "tag", "level", "body", "error"]).astype({"ord": "Int32", "tag": "Int32", "level": "Int32"})

    return streams.select("path", "entry", "content").mapInPandas(run, "path string, entry string, ord int, tag int, level int, body binary, error string")


def zip_of(files: list[tuple[str, bytes]]) -> bytes:
    """A ZIP with UTF-8 names; an entry is stored where deflating would not shrink it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            shrinks = len(zlib.compress(data, 9)) - 6 < len(data)
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED if shrinks else zipfile.ZIP_STORED)
    return out.getvalue()


def replace_entries(content: bytes, new: dict[str, bytes]) -> bytes:
    """A ZIP with some entries replaced; order, names and methods of all entries stay."""
    if not new:
        return content
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w") as w:
        missing = set(new) - set(z.namelist())
        if missing:
            raise KeyError(f"no such entries: {', '.join(sorted(missing))}")
        for info in z.infolist():
            w.writestr(info, new.get(info.filename, z.read(info)), info.compress_type)
    return out.getvalue()


def output_names(rows: DataFrame, template: list[str], form: str, row: str) -> DataFrame:
    """``rows`` (form_ord, row, ...) with ``name``: columns named by ``template`` joined, unsafe characters as _, made unique in order of arrival.

    A taken name goes on to " (2)", " (3)" until it is free, also past names that read so themselves. Only names that differ in such
    endings can clash; each such family is one group.
    """
    stem = F.regexp_replace(F.concat_ws("-", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in template)), r'[\\/:*?"<>|\x00-\x1f]', "_")
    stem = F.when(F.trim(stem) == "", F.col(form).cast("string")).otherwise(F.trim(stem))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["form_ord", row], kind="stable")
        names: list[str] = []
        taken: set[str] = set()
        last: dict[str, int] = {}
        for wish in frame["name"]:
            name, n = wish, last.get(wish, 1)
            while name in taken:
                n += 1
                name = f"{wish} ({n})"
            last[wish] = n
            taken.add(name)
            names.append(name)
        return frame.assign(name=names)

    named = rows.withColumn("name", stem).withColumn("_family", F.regexp_replace("name", r"( \(\d+\))+$", ""))
    return named.groupBy("_family").applyInPandas(run, named.schema).drop("_family")


def compound_of(files: dict[str, bytes], cutoff: int = 4096) -> bytes:
    """A compound file (512-byte sectors) of ``files`` (path -> bytes); streams under ``cutoff`` bytes share the small stream.

    Each storage's members form a chain to the right, in the order the format asks for.
    """
    tree: dict[str, dict] = {}
    for path, data in sorted(files.items()):
        *folders, name = path.split("/")
        here = tree
        for f in folders:
            here = here.setdefault(f, {})
        here[name] = data
    rows: list[list] = [["Root Entry", 5, NO_STREAM, NO_STREAM, NO_STREAM, END_OF_CHAIN, 0]]
    bodies: list[tuple[int, bytes]] = []

    def place(members: dict, parent: int) -> None:
        order = sorted(members, key=lambda n: (len(n), n.upper()))
        first = len(rows)
        for i, name in enumerate(order):
            inner = isinstance(members[name], dict)
            rows.append([name, 1 if inner else 2, NO_STREAM, first + i + 1 if i + 1 < len(order) else NO_STREAM, NO_STREAM, END_OF_CHAIN, 0])
        rows[parent][4] = first if order else NO_STREAM
        for i, name in enumerate(order):
            if isinstance(members[name], dict):
                place(members[name], first + i)
            else:
                bodies.append((first + i, members[name]))

    place(tree, 0)
    sectors: list[bytes] = []
    table: list[int] = []

    def lay(data: bytes, into: list[bytes], links: list[int], size: int) -> int:
        if not data:
            return END_OF_CHAIN
        first = len(into)
        into += [data[i : i + size].ljust(size, b"\0") for i in range(0, len(data), size)]
        links += [*range(first + 1, len(into)), END_OF_CHAIN]
        return first

    small: list[bytes] = []
    small_links: list[int] = []
    for n, data in bodies:
        rows[n][6] = len(data)
        rows[n][5] = lay(data, sectors, table, 512) if len(data) >= cutoff else lay(data, small, small_links, 64)
    rows[0][5], rows[0][6] = lay(b"".join(small), sectors, table, 512), 64 * len(small)
    small_first = lay(struct.pack(f"<{-(-len(small_links) // 128) * 128}I", *small_links, *[FREE] * (-len(small_links) % 128)), sectors, table, 512)
    listing = b""
    for name, kind, left, right, child, first, size in rows + [["", 0, NO_STREAM, NO_STREAM, NO_STREAM, 0, 0]] * (-len(rows) % 4):
        raw = name.encode("utf-16-le") + b"\0\0" if name else b""
        listing += raw.ljust(64, b"\0") + struct.pack("<HBB3I16sI8s8sIQ", len(raw), kind, 1, left, right, child, b"", 0, b"", b"", first, size)
    directory = lay(listing, sectors, table, 512)
    n_tables = 1
    while n_tables * 128 < len(table) + n_tables:
        n_tables += 1
    if n_tables > 109:
        raise Damaged("too large for a header's own list of tables")
    own = list(range(len(table), len(table) + n_tables))
    table += [0xFFFFFFFD] * n_tables
    packed = struct.pack(f"<{n_tables * 128}I", *table, *[FREE] * (n_tables * 128 - len(table)))
    sectors += [packed[i : i + 512] for i in range(0, len(packed), 512)]
    head = COMPOUND + b"\0" * 16 + struct.pack("<5H6x", 0x3E, 3, 0xFFFE, 9, 6)
    head += struct.pack("<9I", 0, n_tables, directory, 0, cutoff, small_first, -(-len(small_links) // 128), END_OF_CHAIN, 0)  # from byte 40
    return head + struct.pack("<109I", *own, *[FREE] * (109 - n_tables)) + b"".join(sectors)
