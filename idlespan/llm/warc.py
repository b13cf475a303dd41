"""Zstandard web archives: a dictionary in the leading skippable frame, then one frame per WARC record.

Archives are written by Spark's text writer: an archive is one value, and the line
end is an empty skippable frame, which a Zstandard reader passes over.  So they go
to any store that Spark writes to and appear when the job commits.  They are read
with the ``binaryFile`` source.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlespan.llm.frames import picked, ship

# Magic numbers of Zstandard frames and of the skippable frame that holds a dictionary.
FRAME, DICTIONARY_FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
#: An empty skippable frame (magic 0x184D2A50, length 0): ends every archive.
_END = "P*M\x18\x00\x00\x00\x00"
#: Payload bytes of an archive at most, before compression; a larger record is alone in its own.
ARCHIVE_BYTES = 8 << 20
#: Sizes of a dictionary, and of what it is drawn from.
_DICTIONARY_BYTES, _SAMPLE_BYTES = 32 << 10, 2 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("problem", T.StringType())])


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value: line ends and the percent sign escaped, so that any text comes back."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """One response record, or a revisit record without payload if ``refers_to`` names another."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{_line(record_id)}>",
             f"WARC-Target-URI: {_line(uri)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}",
             f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if refers_to:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_line(refers_to)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """Trained on the records' beginnings; where they are too few, the beginnings themselves."""
    share = max(64, _SAMPLE_BYTES // max(len(records), 1))
    heads = [r[:share] for r in records]
    if len(heads) >= 32 and sum(map(len, heads)) >= 8 * _DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(_DICTIONARY_BYTES, heads, level=3).as_bytes()
        except zstandard.ZstdError:  # too uniform to learn from
            pass
    return b"".join(heads)[:_DICTIONARY_BYTES]


def archive_of(records: list[bytes]) -> bytes:
    """The records' frames behind a compressed dictionary."""
    raw = _dictionary(records)
    packed = zstandard.ZstdCompressor(level=10).compress(raw)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed + b"".join(map(compressor.compress, records))


def read_archive(data: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """(record, problem) of every frame: a dictionary first if there is one, other skippable frames passed over.

    A damaged frame ends the archive, since nothing tells where the next one begins.
    """
    at, dictionary = 0, None
    while at < len(data):
        if len(data) - at < 8:
            yield None, "an archive that ends inside a frame"
            return
        magic, length = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at == 0 and magic == DICTIONARY_FRAME:
                raw = data[8:8 + length]
                if raw[:4] == struct.pack("<I", FRAME):
                    try:
                        raw = zstandard.ZstdDecompressor().decompress(raw)
                    except zstandard.ZstdError:
                        yield None, "a dictionary that cannot be decompressed"
                        return
                dictionary = zstandard.ZstdCompressionDict(raw)
            at += 8 + length
            continue
        # One frame exactly: what follows it comes back unread.
        stream = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {})).decompressobj()
        try:
            record = stream.decompress(memoryview(data)[at:])
        except zstandard.ZstdError as error:
            yield None, f"a frame that cannot be decompressed: {error}"
            return
        if not stream.eof:
            yield None, "an archive that ends inside a frame"
            return
        at = len(data) - len(stream.unused_data)
        yield record, None


def parse(record: bytes) -> tuple:
    """Values of ``RECORD``; what is wrong with headers or lengths stands in ``problem``."""
    values = dict.fromkeys(f.name for f in RECORD.fields)

    def out(problem: str | None) -> tuple:
        return tuple((values | {"problem": problem}).values())

    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return out("no WARC version or end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip() or name.lower() in headers:
            return out(f"a header that is broken or comes twice: {line[:80]}")
        headers[name.lower()] = value.strip()
    if missing := [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if n not in headers]:
        return out(f"no {missing[0]}")
    kind = headers["warc-type"]
    values |= {"record_type": kind, "record_id": _unline(headers["warc-record-id"].removeprefix("<").removesuffix(">")),
               "uri": _unline(headers.get("warc-target-uri", ""))}
    length = headers["content-length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        return out("a content length that is not the block's")
    block = rest[:-4]
    if (given := headers.get("warc-block-digest")) and given != f"sha1:{digest(block)}":
        return out("a block that does not have its digest")
    if kind not in ("response", "revisit"):
        return out(None)
    http, found, payload = block.partition(b"\r\n\r\n")
    sizes = [l.split(b":", 1)[1].strip() for l in http.split(b"\r\n")[1:] if l.lower().startswith(b"content-length:")]
    given = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if not found or not http.startswith(b"HTTP/") or len(sizes) != 1 or not sizes[0].isdigit() or not given:
        return out("no HTTP header, length or payload digest")
    values |= {"payload_digest": given, "payload_bytes": int(sizes[0])}
    if kind == "revisit":
        values["refers_to"] = _unline(headers.get("warc-refers-to", "").removeprefix("<").removesuffix(">"))
        return out(None if values["refers_to"] and not payload else "a revisit with a payload, or that refers to nothing")
    values["payload"] = payload
    if len(payload) != int(sizes[0]) or digest(payload) != given:
        return out("a payload that does not have its length or digest")
    return out(None)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: of equal payloads of that size, the largest page_id, if another.

    Payloads are compared by SHA-256 and length; only the largest id of each goes
    through a shuffle, added up before it.  Null html counts as empty; rows that
    repeat the largest page_id are responses all; a null page_id refers to nothing
    larger and is referred to by nothing unless it stands alone.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    marked = pages.withColumns({"_mark": F.sha2(payload, 256), "_size": F.octet_length(payload)})
    largest = marked.groupBy("_mark", "_size").agg(
        F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_n")).where(f"_n > 1 AND _size >= {int(least_bytes)}")
    return marked.join(largest, ["_mark", "_size"], "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_largest")), F.col("_largest"))).select(
        "page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record per row, into archives of at most about ``archive_bytes`` each, below ``path``.

    A task holds one archive at a time.  A null page_id or url is written as the
    empty text, null html as an empty payload; other columns do not matter; an
    empty table writes no archive.
    """
    ship(pages.sparkSession)
    rows = with_revisits(picked(pages, page_id=page_id, url=url, html=html), least_bytes).select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"), F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                own, uri, text, other = (batch.column(c)[i].as_py() for c in range(4))
                held.append(record_bytes(_urn(own), uri, text.encode("utf-8", "surrogatepass"), other and _urn(other)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive_of(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive_of(held)], pa.binary())], ["archive"])

    made = rows.mapInArrow(run, "archive binary")
    made.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", _END).option(
        "maxRecordsPerFile", 1).option("compression", "none").text(path)


def _urn(page_id: str) -> str:
    return f"urn:page:{page_id}"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive`` (file) and ``RECORD`` of every record below ``path``; faults are rows with a ``problem``."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for record, problem in read_archive(content.as_buffer().to_pybytes()):
                    rows.append(parse(record) if problem is None else (*[None] * (len(RECORD) - 1), problem))
                    size += len(record or b"")
                    if size >= ARCHIVE_BYTES // 2:
                        yield table(name, rows)
                        rows, size = [], 0
                if rows:
                    yield table(name, rows)

    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    fields = [(f.name, kinds[f.dataType]) for f in RECORD.fields]

    def table(name, rows):
        columns = [pa.array([name] * len(rows), pa.string())]
        columns += [pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), fields)]
        return pa.RecordBatch.from_arrays(columns, ["archive", *[n for n, _ in fields]])

    return files.mapInArrow(run, T.StructType([T.StructField("archive", T.StringType()), *RECORD.fields]))


def page_of(column: str) -> Column:
    """The page_id in a record id that ``write_archives`` made; null where it was null."""
    return F.regexp_extract(column, "^urn:page:(.*)$", 1).try_cast("long")
