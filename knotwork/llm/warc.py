"""WARC records in seekable Zstandard bundles.

A bundle is a .warc.zst file: records are grouped into independent Zstandard frames of about FRAME_BYTES, and the file
ends with a seek table in a skippable frame (the public seekable format: per frame its compressed and uncompressed size,
then frame count, descriptor and magic). A separate index maps each record id to its bundle, frame, offset inside the
uncompressed frame, and length, so a record is read by decompressing one frame.

Payload digests (SHA-256, as payloads of one SHA-1 can be made) are grouped in a narrow table first; only digests that
occur more than once meet the payloads again, by broadcast while they fit BROADCAST_DIGESTS and by a shuffle beyond.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import filesystem, map_batches, materialize, partitions, publish, scratch, sent

FRAME_BYTES, LEVEL = 1 << 20, 3
BROADCAST_DIGESTS = 200_000
#: Magic numbers of the skippable frame and of the seek table's footer, fixed by the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
WARC_DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, record_id string, bundle string, frame int, frame_offset long, record_bytes long"


def record_id(page_id, twin=None) -> str:
    """The id of a page's record; twin tells records of one page id, and those without one, apart."""
    return f"urn:page:{'' if page_id is None else page_id}{'' if twin is None else f':{twin}'}"


def _header_value(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def make_record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False, twin=None) -> bytes:
    """A WARC/1.1 record whose block is an HTTP response; a revisit keeps the HTTP head and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, twin)}>", f"WARC-Date: {WARC_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's headers and payload; payload_bytes and payload_digest are of the full payload also for revisits."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1" or data[-4:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    revisit = headers["WARC-Type"] == "revisit"
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix("urn:page:").partition(":")[0]) else None
    url = headers.get("WARC-Target-URI")
    return {
        "page_id": number(headers["WARC-Record-ID"]), "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "record_type": headers["WARC-Type"],
        "payload_bytes": length, "payload_digest": digest, "refers_to": number(headers["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


class BundleWriter:
    """Appends records to frames of a stream; close() writes the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.out, self.most, self.compress = out, frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.held, self.size, self.frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset in the uncompressed frame, bytes) of the record."""
        if self.size and self.size + len(record) > self.most:
            self.flush()
        at = (len(self.frames), self.size, len(record))
        self.held.append(record)
        self.size += len(record)
        return at

    def flush(self) -> None:
        if self.held:
            data = self.compress(b"".join(self.held))
            self.out.write(data)
            self.frames.append((len(data), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Reads single frames of a bundle through its seek table."""

    def __init__(self, file):
        self.file, end = file, file.size()
        count, flags, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        table = file.read_at(entry * count, end - 9 - entry * count)
        sizes = [struct.unpack_from("<II", table, entry * k) for k in range(count)]
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, n: int) -> bytes:
        import zstandard

        at, packed, plain = self.frames[n]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


def with_roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """pages with _first (the largest id among equal payloads of at least min_bytes, else null)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    key = [F.sha2(payload, 256).alias("_sha"), F.octet_length(payload).alias("_bytes")]
    groups = pages.select(F.col(id_col).alias("_id"), *key).filter(F.col("_bytes") >= min_bytes).groupBy("_sha", "_bytes").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shared = materialize(groups.filter("_n > 1").drop("_n"), "shared-digests")
    n = shared.count()
    if not n:
        return pages.withColumn("_first", F.lit(None).cast(pages.schema[id_col].dataType))
    shared = F.broadcast(shared) if n <= broadcast_digests else shared
    return pages.select("*", *key).join(shared, ["_sha", "_bytes"], "left").drop("_sha", "_bytes")


def with_twins(pages: DataFrame) -> DataFrame:
    """pages (page_id, ...) with _twin: null for the first row of a page id, a number of its own for other rows and null ids."""
    placed = pages.withColumn("_at", F.monotonically_increasing_id())
    firsts = placed.groupBy("page_id").agg(F.min("_at").alias("_first_at"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1 or page_id is null")
    firsts = materialize(firsts.select(F.col("page_id").alias("_of"), "_first_at"), "repeated-ids")
    if firsts.isEmpty():
        return pages.withColumn("_twin", F.lit(None).cast("long"))
    joined = placed.join(sent(firsts), F.col("page_id").eqNullSafe(F.col("_of")), "left")
    twin = F.when(F.col("page_id").isNull() | (F.col("_at") != F.col("_first_at")), F.col("_at"))
    return joined.withColumn("_twin", twin).drop("_at", "_of", "_first_at")


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes a record per row to bundles below folder and returns the index, itself written as a table.

    The payload is payload_col in UTF-8; null counts as empty. Of records with equal payloads of at least min_bytes the
    one with the largest id is a response and the others revisit it; rows that repeat that id are all responses. Records
    with a null id are responses. Records without an id, and all but one of those that share one, have a number appended
    to their record id, which is thus unique. Null urls give no WARC-Target-URI. An empty table gives an empty index. A repeated
    task writes a bundle of a new name, and the index names the bundles of the tasks that counted.
    """
    rows = with_twins(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html")))
    rows = with_roles(rows, "page_id", "html", min_bytes).select("page_id", "url", "html", F.col("_first").alias("first"), F.col("_twin").alias("twin"))

    def write(batches):
        import pyarrow as pa

        uri, index = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst", []
        first = next(batches, None)
        if first is None:
            return

        def fill(out):
            bundle = BundleWriter(out, frame_bytes)
            batch = first
            while batch is not None:
                for k in range(batch.num_rows):
                    page, url, html, refers, twin = (batch.column(c)[k].as_py() for c in range(5))
                    revisit = refers is not None and page is not None and page != refers
                    index.append((page, record_id(page, twin), uri, *bundle.add(make_record(page, url, (html or "").encode(), refers, revisit, twin))))
                batch = next(batches, None)
            bundle.close()

        publish(uri, fill)
        names = ["page_id", "record_id", "bundle", "frame", "frame_offset", "record_bytes"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        for at in range(0, len(index), 10_000):
            columns = zip(*index[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return materialize(map_batches(rows, write, INDEX), "warc-index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that an index names, read frame by frame: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if asked for, payload.

    Any part of an index will do: only the frames in which its records lie are decompressed, each once. A frame holds
    about FRAME_BYTES, so the records of one frame are few. The frames, not the small rows of the index, are the work: they
    are dealt to as many tasks as a shuffle has.
    """
    dealt = index.repartition(partitions(index.sparkSession), "bundle", "frame")
    frames = dealt.groupBy("bundle", "frame").agg(F.collect_list(F.struct("frame_offset", "record_bytes")).alias("places"))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads

    def read(batches):
        import pyarrow as pa

        name = file = reader = None
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    name = row["bundle"]
                    where, path = filesystem(name)
                    if file is not None:
                        file.close()
                    file = where.open_input_file(path)
                    reader = BundleReader(file)
                data = reader.frame(row["frame"])
                found = [parse_record(data[p["frame_offset"] : p["frame_offset"] + p["record_bytes"]]) for p in row["places"]]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in kinds.items()], names=list(kinds))

    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(read, schema)


def archive_query(pages: DataFrame) -> DataFrame:
    """The registered query: writes all pages to bundles in the shared folder and reads every record back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_records(write_bundles(pages, folder), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS first FROM p),
bits AS (SELECT page_id, payload_bytes, first, h, string_agg(bin(('0x' || substr(h, i + 1, 1))::INT + 16)[-4:], '' ORDER BY i) AS b
         FROM g, range(40) t(i) GROUP BY ALL),
d AS (SELECT page_id, payload_bytes, first, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (substr(b, 5 * j + 1, 1)::INT * 16 + substr(b, 5 * j + 2, 1)::INT * 8 + substr(b, 5 * j + 3, 1)::INT * 4 + substr(b, 5 * j + 4, 1)::INT * 2 + substr(b, 5 * j + 5, 1)::INT) + 1, 1), '' ORDER BY j) AS payload_digest
      FROM bits, range(32) t(j) GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
