"""WARC archives, one Zstandard frame a record, with a dictionary in the leading skippable frame.

The writer deals pages over archives of bounded size and puts the trained
dictionary into a skippable frame at the head of each. The reader loads the
dictionary from there, decodes one frame per record, and validates magic
numbers, header fields, lengths and payload digests. Pages with equal payloads
of `least` bytes or more are stored once; the others are revisit records.

Archives are files of the shared folder. They are written under a name of the
task's attempt and moved to their place. Records stand in the order of page_id,
url and payload, so a task that runs again cuts the same archives and replaces
each by an equal one. The reader takes an archive a chunk at a time, in time
linear in its length.

Edge cases: a null or empty html is a response of no bytes; of rows that repeat
the least page_id of a payload each is a response; an empty table makes no
archive and reads as no record; damaged archives raise ValueError; ids may be
of any type that text can be cast to; other columns than page_id, url and html
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, shared_folder

#: The skippable frame that holds the dictionary, and the magic numbers of frames and dictionaries.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
ARCHIVE_BYTES = 8_000_000
DICTIONARY_BYTES = 65_536
CHUNK = 65_536
FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2024-01-01T00:00:00Z"


def train(pages: DataFrame, column: str = "html", rows: int = 500, chars: int = 50_000) -> bytes:
    """A dictionary from at most `rows` pages of at most `chars` characters, in the order of a hash; empty if they are too few."""
    samples = [x.encode() for x in hashed_sample(pages.where(F.length(column).between(1, chars)), column, rows)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # samples too small or too few for a dictionary
        return b""


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: object, url: str | None, payload: bytes, refers_to: object) -> bytes:
    """A response record with its payload, or a revisit record of the response that refers_to names."""
    digest = f"sha256:{hashlib.sha256(payload).hexdigest()}"
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": digest}
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        body += payload
    else:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page": str(refers_to)}
    if page_id is not None:
        head["X-Page"] = str(page_id)
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def read_record(raw: bytes) -> dict:
    """The fields of a record; raises ValueError if its headers or lengths are wrong."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no header field: {line[:40]!r}")
        fields[key] = value.strip()
    if missing := [f for f in FIELDS if f not in fields]:
        raise ValueError(f"fields are missing: {missing}")
    if not fields["Content-Length"].isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the record's length isn't its Content-Length")
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    told = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    n = int(told["Content-Length"])
    fields |= {"payload": payload, "payload_bytes": n}
    if fields["WARC-Type"] == "response":
        if not mark or len(payload) != n:
            raise ValueError("the payload's length isn't its Content-Length")
        if fields["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise ValueError("the payload's digest is wrong")
    elif fields["WARC-Type"] != "revisit" or "WARC-Refers-To" not in fields or payload:
        raise ValueError("neither a response nor a revisit record")
    return fields


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def frames(archive: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, the dictionary taken from its leading skippable frame."""
    place, dictionary = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", archive, 4)[0]
        held = archive[8 : 8 + size]
        if len(held) != size:
            raise ValueError("the dictionary is cut off")
        if held[:4] == struct.pack("<I", FRAME):
            held = zstandard.ZstdDecompressor().decompress(held)
        if held and held[:4] != struct.pack("<I", DICTIONARY):
            raise ValueError("the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(held) if held else None
        place = 8 + size
    whole = memoryview(archive)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while place < len(archive):
        if bytes(whole[place : place + 4]) != struct.pack("<I", FRAME):
            raise ValueError(f"no Zstandard frame at byte {place}")
        one, out, start = decoder.decompressobj(), [], place
        while not one.eof:
            chunk = whole[place : place + CHUNK]
            if not chunk:
                raise ValueError(f"the frame at byte {start} is cut off")
            try:
                out.append(one.decompress(chunk))
            except zstandard.ZstdError as e:
                raise ValueError(f"damaged frame at byte {start}: {e}") from e
            place += len(chunk)
        place -= len(one.unused_data)
        yield b"".join(out)


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def referrals(pages: DataFrame, least: int = 100) -> DataFrame:
    """(digest, first): payloads of `least` bytes or more that more than one row holds, and the least page_id of them."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    light = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.length(payload).alias("bytes")).where(F.col("bytes") >= least)
    return light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")


def write(pages: DataFrame, folder: str, least: int = 100) -> None:
    """Write pages (page_id, url, html) as archives into a shared folder."""
    dictionary = train(pages)
    digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
    dealt = pages.select("page_id", "url", "html", digest.alias("digest")).join(referrals(pages, least), "digest", "left").select("page_id", "url", "html", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to")).sortWithinPartitions("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = filesystem(folder)
        system.create_dir(top, recursive=True)
        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        compressor = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        number, rows, held, size = 0, 0, [], 0

        def flush() -> None:
            nonlocal number, held, size
            if held:
                name = f"{top}/pages-{task:06d}-{number:04d}.warc.zst"
                with system.open_output_stream(f"{top}/.{attempt}-{number}.tmp") as out:
                    out.write(skippable(dictionary) + b"".join(held))
                system.move(f"{top}/.{attempt}-{number}.tmp", name)
                number, held, size = number + 1, [], 0

        for batch in batches:
            for page_id, url, text, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                frame = compressor.compress(record(page_id, url, (text or "").encode("utf-8", "surrogatepass"), refers_to))
                held.append(frame)
                rows, size = rows + 1, size + len(frame)
                if size > ARCHIVE_BYTES:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    dealt.mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


def read(spark: SparkSession, folder: str, payload: bool = False, ids: str = "bigint") -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of the archives' records; page ids are of type `ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows: list[tuple] = []
                for raw in frames(archive.as_py()):
                    x = read_record(raw)
                    rows.append((x.get("X-Page"), x["WARC-Target-URI"], x["WARC-Type"], x["payload_bytes"], x["WARC-Payload-Digest"].partition(":")[2], x.get("X-Refers-To-Page"), *([x["payload"]] if payload else [])))
                    if len(rows) == 500:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if payload else [])]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payload else [])]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    found = files.mapInArrow(run, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + (", payload binary" if payload else ""))
    return found.withColumns({c: F.col(c).cast(ids) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write pages as archives into the shared folder and read them back."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    system, top = filesystem(folder)
    system.create_dir(top, recursive=True)
    write(pages, folder, least)
    return read(pages.sparkSession, folder, ids=pages.schema["page_id"].dataType.simpleString())
