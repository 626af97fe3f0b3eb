"""WARC archives compressed record by record with a Zstandard dictionary built from their own records.

An archive is a leading skippable frame that holds the dictionary, and then one frame for each record, so that any record can
be read alone. Payloads are stored once: of records with equal payloads that of the smallest page is the response, the others
refer to it. Which is which is settled by an aggregate over digests before any task writes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import folder, kept

#: Fixed by the format: the magic number of the skippable frame for dictionaries, and record line ends.
SKIPPABLE, EOL = 0x184D2A5D, b"\r\n"
#: A header of our own: the URI held line ends and is escaped, so that reading back can undo it.
ESCAPED = "X-URI-Escaped"
ARCHIVE_BYTES, DICTIONARY_BYTES, LEVEL = 16 << 20, 112_640, 3
#: What trains an archive's dictionary: pieces of its records, evenly spaced, up to so many bytes together.
TRAIN_BYTES, PIECE_BYTES = 4 << 20, 128 << 10
DATE = "1970-01-01T00:00:00Z"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to, digest: str, date: str) -> bytes:
    """One record. A revisit keeps the HTTP head, which tells the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None and ("\r" in url or "\n" in url):
        head += [("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")), (ESCAPED, "yes")]
    elif url is not None:
        head.append(("WARC-Target-URI", url))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + EOL + block + EOL + EOL


def samples(records: list[bytes], limit: int = TRAIN_BYTES, piece: int = PIECE_BYTES) -> list[bytes]:
    """Pieces of the records, evenly spaced over all of their bytes, of about ``limit`` bytes together."""
    step = max(1, -(-sum(map(len, records)) // limit))
    out, passed, due = [], 0, 0
    for r in records:
        for a in range(0, len(r), piece):
            part = r[a : a + piece]
            passed += len(part)
            if passed > due:
                out.append(part)
                due += step * len(part)
    return out


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES):
    """A dictionary trained on the archive's records; None where they are too few or too small to train one."""
    import zstandard

    some = samples(records)
    for pieces in (some, [r[a : a + 256] for r in some for a in range(0, len(r), 256)]):
        try:
            return zstandard.train_dictionary(min(size, max(1024, sum(map(len, records)) // 8)), pieces, d=8, k=256, f=18, accel=4)
        except zstandard.ZstdError:
            continue
    return None


def write_archive(fs: pafs.FileSystem, path: str, records: list[bytes], level: int = LEVEL) -> int:
    """Writes under another name and moves the whole file into its place. Returns its bytes."""
    import zstandard

    trained = dictionary(records)
    press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    raw, size = trained.as_bytes() if trained else b"", 0
    lead = [struct.pack("<II", SKIPPABLE, len(raw)) + raw] if trained else []
    with fs.open_output_stream(f"{path}.part", compression=None) as out:
        for part in (*lead, *(press.compress(r) for r in records)):
            out.write(part)
            size += len(part)
    fs.move(f"{path}.part", path)
    return size


class Joined:
    """What was read already, and the rest of the stream."""

    def __init__(self, begin: bytes, rest):
        self.begin, self.rest = begin, rest

    def read(self, n: int = -1) -> bytes:
        out, self.begin = self.begin, b""
        return out or self.rest.read(n)


def read_archive(fs: pafs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, as a stream."""
    import zstandard

    with fs.open_input_stream(path, compression=None, buffer_size=1 << 16) as f:
        begin = f.read(8)
        magic, n = struct.unpack("<II", begin)
        if magic == SKIPPABLE:
            source, trained = f, zstandard.ZstdCompressionDict(f.read(n))
        else:
            source, trained = Joined(begin, f), None
        reader = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(source, read_across_frames=True)
        held = bytearray()

        def more() -> bool:
            got = reader.read(1 << 16)
            held.extend(got)
            return bool(got)

        while True:
            while (end := held.find(b"\r\n\r\n")) < 0:
                if not more():
                    if held:
                        raise ValueError(f"{path} ends inside a record")
                    return
            lines = bytes(held[:end]).decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"{path}: a record begins with {lines[0][:40]!r}")
            head = dict(line.split(": ", 1) for line in lines[1:])
            size = int(head["Content-Length"])
            while len(held) < end + 8 + size:
                if not more():
                    raise ValueError(f"{path} ends inside a record")
            yield head, bytes(held[end + 4 : end + 4 + size])
            del held[: end + 8 + size]


def archive(pages: DataFrame, target: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) as archives below the URI ``target``, which all executors share; returns the
    manifest: path, n_records, raw_bytes, packed_bytes.

    Payload: the html in UTF-8, empty for null. Of records with equal payloads of ``least_bytes`` or more, those of the smallest
    page_id are responses and the others revisit it; a null page_id is smaller than none, and rows that repeat the smallest id
    are responses too. Where no row of a payload has an id, all are responses. A null url is left out. Empty pages give an empty
    manifest. Other columns are not archived.
    """
    cols = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    cols = cols.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    firsts = cols.groupBy("digest").agg(F.min("page_id").alias("first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= least_bytes)
    rows = cols.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(target)
        fs.create_dir(top, recursive=True)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            path = f"{top}/pages-{uuid.uuid4().hex}.warc.zst"
            packed = write_archive(fs, path, held)
            return pa.RecordBatch.from_pydict({"path": [f"{target}/{path.rpartition('/')[2]}"], "n_records": [len(held)], "raw_bytes": [size], "packed_bytes": [packed]})

        for batch in batches:
            for page, url, html, sha1, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page, url, html.encode(), "response" if refers is None else "revisit", refers, base32(sha1), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return kept(rows.mapInArrow(run, "path string, n_records long, raw_bytes long, packed_bytes long"))


def read_back(spark: SparkSession, manifest: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """One row for each record in the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length are computed anew and must agree with its headers; a revisit's are those of its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                out = []
                for head, block in read_archive(fs, path):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != told):
                        raise ValueError(f"{uri}: payload and headers of {head['WARC-Record-ID']} differ")
                    name = lambda x: x.removeprefix("<urn:page:").removesuffix(">") or None
                    url = head.get("WARC-Target-URI")
                    if ESCAPED in head:
                        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                    out.append((name(head["WARC-Record-ID"]), url, length, told, head["WARC-Type"], name(head.get("WARC-Refers-To", ""))))
                    if len(out) >= 5000:
                        yield rows(out)
                        out = []
                if out:
                    yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    paths = manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    out = paths.mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    kind = id_type or T.LongType()
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def round_trip(pages: DataFrame, target: str | None = None, **options) -> DataFrame:
    """``archive`` and ``read_back``."""
    spark = pages.sparkSession
    return read_back(spark, archive(pages, target or folder(spark), **options), pages.schema["page_id"].dataType)
