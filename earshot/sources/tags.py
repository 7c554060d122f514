"""Tags of audio files as a table: a data source that reads the head of each file only.

    spark.dataSource.register(TagSource)
    spark.read.format("tags").option("paths", json.dumps(paths)).load()

A partition is a run of files of about as many bytes to read. What a file's head does not tell is taken from its name.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at first, and at most where the head says that its tags are longer; files of a partition.
HEAD, MOST, FILES = 4_096, 1 << 20, 256
SCHEMA = "path string, title string, artist string, album string, album_artist string, genre string, year int, track_no int, disc_no int, duration double, format string, bytes_read long"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
# Names of text frames and of comments, by our columns.
ID3 = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TPE2": "album_artist", "TCON": "genre", "TYER": "year", "TDRC": "year", "TRCK": "track_no", "TPOS": "disc_no"}
VORBIS = {"TITLE": "title", "ARTIST": "artist", "ALBUM": "album", "ALBUMARTIST": "album_artist", "GENRE": "genre", "DATE": "year", "TRACKNUMBER": "track_no", "DISCNUMBER": "disc_no"}
_NUMBERS = {"year", "track_no", "disc_no"}
_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


class Head:
    """The first bytes of a file, read as far as they are asked for."""

    def __init__(self, stream):
        self.stream, self.data = stream, b""

    def upto(self, n: int) -> bytes:
        n = min(max(n, HEAD), MOST)
        if n > len(self.data):
            self.data += self.stream.read(n - len(self.data))
        return self.data


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3_frames(head: Head) -> Iterator[tuple[str, str]]:
    """Text frames of an ID3v2.3 or 2.4 tag, in their order. A frame that is cut off ends the tag."""
    data = head.upto(HEAD)
    major, flags, size = data[3], data[5], _synchsafe(data[6:10])
    body = head.upto(10 + size)[10 : 10 + size]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and len(body) >= 4:
        at = _synchsafe(body[:4]) if major == 4 else 4 + struct.unpack(">I", body[:4])[0]
    while at + 10 <= len(body) and body[at : at + 4].strip(b"\0"):
        name, own = body[at : at + 4].decode("latin-1"), body[at + 4 : at + 8]
        n = _synchsafe(own) if major == 4 else struct.unpack(">I", own)[0]
        content = body[at + 10 : at + 10 + n]
        if len(content) < n:
            return
        if name in ID3 and content:
            yield name, content[1:].decode(_ENCODINGS.get(content[0], "latin-1"), "replace").split("\0")[0]
        at += 10 + n


def comments(block: bytes) -> Iterator[tuple[str, str]]:
    """Name and value of the comments of a Vorbis comment block; what is cut off is left out."""
    try:
        (n,) = struct.unpack_from("<I", block, 0)
        at = 4 + n
        (count,) = struct.unpack_from("<I", block, at)
        at += 4
        for _ in range(count):
            (n,) = struct.unpack_from("<I", block, at)
            text = block[at + 4 : at + 4 + n]
            if len(text) < n:
                return
            name, _, value = text.decode("utf-8", "replace").partition("=")
            yield name.upper(), value
            at += 4 + n
    except struct.error:
        return


def flac(head: Head) -> tuple[list[tuple[str, str]], float | None]:
    """Comments and length in seconds of a FLAC file: its metadata blocks are passed over one by one."""
    at, found, seconds = 4, [], None
    while True:
        data = head.upto(at + 4)
        if len(data) < at + 4:
            return found, seconds
        last, kind, n = data[at] & 0x80, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind in (0, 4):
            block = head.upto(at + 4 + n)[at + 4 : at + 4 + n]
            if kind == 0 and len(block) >= 18:
                packed = int.from_bytes(block[10:18], "big")
                rate, samples = packed >> 44, packed & ((1 << 36) - 1)
                seconds = samples / rate if rate and samples else None
            elif kind == 4:
                found = list(comments(block))
        at += 4 + n
        if last or at >= MOST:
            return found, seconds


def ogg_packets(head: Head, n: int) -> list[bytes]:
    """The first n packets of an Ogg stream, put together over pages, as far as the head goes."""
    at, packets, now = 0, [], b""
    while len(packets) < n:
        data = head.upto(at + 27 + 255)
        if data[at : at + 4] != b"OggS" or len(data) < at + 27:
            break
        count = data[at + 26]
        lacing = data[at + 27 : at + 27 + count]
        body = at + 27 + count
        data = head.upto(body + sum(lacing))
        for size in lacing:
            now += data[body : body + size]
            body += size
            if size < 255:
                packets.append(now)
                now = b""
        at = body
        if at >= MOST:
            break
    return [*packets, now][:n]


def file_tags(name: str, stream) -> dict:
    """The row of one file: its tags, blanks as nothing, then artist and title from a name like "Artist - Title"."""
    head, out = Head(stream), dict.fromkeys(_COLUMNS)
    data, names, found = head.upto(HEAD), {}, []
    try:
        if data[:3] == b"ID3" and len(data) >= 10:
            out["format"], names, found = "id3", ID3, list(id3_frames(head))
        elif data[:4] == b"fLaC":
            found, out["duration"] = flac(head)
            out["format"], names = "flac", VORBIS
        elif data[:4] == b"OggS":
            packet = ogg_packets(head, 2)[-1]
            skip = 7 if packet[:7] == b"\x03vorbis" else 8 if packet[:8] == b"OpusTags" else len(packet)
            out["format"], names, found = "ogg", VORBIS, list(comments(packet[skip:]))
    except (IndexError, struct.error, UnicodeError):
        found = []
    for key, value in found:
        column, value = names.get(key), value.strip()
        if column and value and out[column] is None:
            number = re.match(r"\d+", value)
            out[column] = (int(number[0]) if number else None) if column in _NUMBERS else value
    stem = re.sub(r"\.[^.]*$", "", re.split(r"[\\/]", name)[-1])
    artist, dash, title = stem.partition(" - ")
    if dash:
        out["artist"], out["title"] = out["artist"] or artist.strip(), out["title"] or title.strip()
    out["title"] = out["title"] or stem
    return out | {"path": name, "bytes_read": len(head.data)}


@dataclass
class Files(InputPartition):
    paths: list[str]


def _opened(path: str):
    if "://" in path:
        system, at = fs.FileSystem.from_uri(path)
    else:
        system, at = fs.LocalFileSystem(), path
    return system.open_input_file(at)


class TagSource(DataSource):
    """Tags of a list of files, given as JSON in the option paths; a path that can't be read has the tags of its name. files: how many files a partition reads."""

    @classmethod
    def name(cls) -> str:
        return "tags"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TagReader(json.loads(self.options["paths"]), int(self.options.get("files", FILES)))


class TagReader(DataSourceReader):
    def __init__(self, paths: list[str], files: int):
        self.paths, self.files = list(dict.fromkeys(paths)), files

    def partitions(self) -> list[Files]:
        return [Files(self.paths[a : a + self.files]) for a in range(0, len(self.paths), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return (tuple(row[c] for c in _COLUMNS) for row in map(tags_at, partition.paths))


def tags_at(path: str) -> dict:
    try:
        with _opened(path) as stream:
            return file_tags(path, stream)
    except OSError:
        import io

        return file_tags(path, io.BytesIO())


def tags_of(files: DataFrame) -> DataFrame:
    """The same for a table of files (path) of any length, each task reading the heads of its own."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [tags_at(p) for p in b.column(0).to_pylist()]
            types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[t]) for c, t in (x.split() for x in SCHEMA.split(", "))], names=_COLUMNS)

    return files.where("path is not null").select("path").distinct().mapInArrow(run, SCHEMA)


def tags_of_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(TagSource)
    return spark.read.format("tags").option("paths", json.dumps(paths)).load()
