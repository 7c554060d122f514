"""WARC archives: a writer of one gzip member a record, and a splittable reader.

The reader cuts files into byte ranges. A task looks for the gzip magic in its range, takes a place for a member if what
decodes there begins as a WARC record, owns the records that begin in its range, and reads past its end to finish the last.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _delete, materialize, parallelism, qualified, shared_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT, CHUNK = 8 << 20, 1 << 20
_PAGE = "urn:page:"
RECORD = "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload binary"


def record(page_id, url, payload: bytes, refers_to, digest: str) -> bytes:
    """One record as a gzip member; a revisit (refers_to is set) leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{_PAGE}{'null' if page_id is None else page_id}>"}
    if url:
        fields["WARC-Target-URI"] = " ".join(url.split("\r")).replace("\n", " ")
    fields |= {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{_PAGE}{refers_to}>"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(text.encode("utf-8", "replace") + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes):
    """The fields of a decoded record, and its payload: what follows the HTTP header of its block, None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    block = rest[: int(fields.get("content-length", 0))]
    payload = None if fields.get("warc-type") == "revisit" else block.partition(b"\r\n\r\n")[2]
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    return fields.get("warc-type"), bare("warc-record-id"), bare("warc-refers-to"), fields.get("warc-target-uri"), (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None, payload


def members(path: str, start: int, end: int):
    """Decoded records whose first byte lies in [start, end) of the file."""
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name) as f:
        size = f.size()
        at, held = start, b""  # held: bytes from at on
        while at < end:
            if len(held) < len(MAGIC):
                held += f.read_at(min(CHUNK, size - at - len(held)), at + len(held))
            k = held.find(MAGIC)
            if k < 0:
                keep = len(held) - len(MAGIC) + 1
                if at + len(held) >= size or keep <= 0:
                    return
                at, held = at + keep, held[keep:] + f.read_at(min(CHUNK, size - at - len(held)), at + len(held))
                continue
            at, held = at + k, held[k:]
            if at >= end:
                return
            raw, used, held = _member(f, at, held, size)
            if raw is None:
                at, held = at + 1, held[1:]
            else:
                yield raw
                at, held = at + used, held[used:]


def _member(f, at: int, held: bytes, size: int):
    """The decoded record at a place, its length in the file, and the bytes read so far; None for what is no record."""
    z, out, fed, begun = zlib.decompressobj(31), [], 0, b""
    while not z.eof:
        if fed == len(held):
            more = f.read_at(min(CHUNK, size - at - len(held)), at + len(held)) if at + len(held) < size else b""
            if not more:
                return None, 0, held
            held += more
        part = held[fed : fed + 65536]
        fed += len(part)
        try:
            got = z.decompress(part)
        except zlib.error:
            return None, 0, held
        out.append(got)
        if len(begun) < 5:
            begun += got[:5]
            if not b"WARC/".startswith(begun[:5]):
                return None, 0, held
    raw = b"".join(out)
    return (raw if raw.startswith(b"WARC/") else None), fed - len(z.unused_data), held


def write_warc(records: DataFrame, folder: str) -> None:
    """Write page_id, url, payload, digest, refers_to as archives in a folder, one a task. A task that runs again writes its own file anew and only the file of a task that ended counts."""
    def run(batches):
        name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        where, path = fs.FileSystem.from_uri(name)
        out, n = None, 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                out = out or where.open_output_stream(path, compression=None)
                member = record(row[0], row[1], row[2], row[4], row[3])
                out.write(member)
                n += len(member)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "size"])

    made = records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, size long")
    made.write.parquet(f"{folder}/index")


def read_warc(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """The records of the archives of a folder, as RECORD; files are read in ranges of split bytes."""
    def run(batches):
        for b in batches:
            for path, start, end in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                rows, size = [], 0
                for raw in members(path, start, end):
                    rows.append(parse(raw))
                    size += len(raw)
                    if size >= 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    files = spark.read.parquet(f"{folder}/index")
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least("size", F.col("start") + split).alias("end"))
    return ranges.repartition(parallelism(spark)).mapInArrow(run, RECORD)


def _batch(rows):
    kinds = [pa.string()] * 5 + [pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of rows with equal payloads that with the largest page_id stays, the others refer to it.

    A null page_id is below all others. Rows that share the largest page_id of a payload, and payloads whose every page_id is null, all stay.
    """
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    full = full.withColumn("hex", F.sha1("payload"))
    tops = full.groupBy("hex").agg(F.max("page_id").alias("top"))
    joined = full.join(tops, "hex")
    refers = F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    return joined.select("page_id", "url", "payload", base32(F.col("hex")).alias("digest"), refers.alias("refers_to"))


def base32(hexed):
    """Hexadecimal digits of 160 bits as 32 base32 digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = lambda k: F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("long")
    digits = [F.substring(F.lit(letters), (F.shiftright(five(k), 5 * (3 - j)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8) for j in range(4)]
    return F.concat(*digits)


def archive_digests(pages: DataFrame, folder: str | None = None, split: int = SPLIT) -> DataFrame:
    """Write pages as archives, read them back, and return page_id, payload_bytes, payload_digest, record_type, refers_to per record.

    - Null html is an empty payload; a null url leaves the target out; a null page_id is kept as null.
    - Repeated rows give a record each. No pages give no archive and an empty result. Other columns are ignored.
    - The bytes and the digest come from the payload that was read; a revisit takes them from the record it refers to.
    - folder is taken as Spark takes it: without a scheme it lies in the default file system. One that pyarrow can't reach is an error at once.
      Without a folder the archives lie in the shared one until they are read, and then go.
    """
    spark = pages.sparkSession
    own = folder is None
    folder = qualified(spark, folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    try:
        fs.FileSystem.from_uri(folder)
    except (ValueError, OSError) as x:  # before anything is written
        raise ValueError(f"archives are written through pyarrow, which can't reach {folder}") from x
    write_warc(with_revisits(pages), folder)
    number = lambda c: F.when(F.col(c) != _PAGE + "null", F.substring(F.col(c), len(_PAGE) + 1, 40).cast("long"))
    read = read_warc(spark, folder, split).select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("bytes"), base32(F.sha1("payload")).alias("digest"), "record_type", number("refers_to").alias("refers_to"), F.col("payload_digest").alias("said"))
    read = materialize(read, "records")
    if own:
        _delete(spark, folder)
    kept = read.where("record_type = 'response'").select(F.col("page_id").alias("top"), F.col("digest").alias("found"), F.col("bytes").alias("n")).distinct()
    again = read.where("record_type = 'revisit'").alias("r").join(kept.alias("k"), (F.col("r.refers_to") == F.col("k.top")) & (F.col("r.said") == F.col("k.found")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    one = read.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return one.union(again.select("r.page_id", F.col("k.n"), F.col("k.found"), "r.record_type", "r.refers_to")).toDF(*columns)
