"""WARC archives as seekable Zstandard bundles.

A task writes its records into bundle files: records are grouped into frames
that decompress independently, and a footer (a skippable frame in the public
seekable format) lists the frames' sizes. The index maps every record to its
bundle, the frame's place in it and the record's place in the frame, so one
record costs one ranged read and one frame.
"""

from __future__ import annotations

import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import pieces
from skein.llm.files import Reader, fresh, make_folder, opened
from skein.session import cut_lineage, scratch_path

#: record bytes after which a frame ends, and file bytes after which a bundle does
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
#: payloads of at least so many bytes are written once
MIN_SHARED = 100
#: a payload with more than 1/HOT of the shared rows is known in every task
HOT = 1000
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ------------------------------------------------------------ records
def record(page, url, payload: bytes, digest: str, size: int, refers_to, own: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload if own else head
    fields = [("WARC-Type", "response" if own else "revisit"), ("WARC-Record-ID", f"<urn:page:{_name(page)}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if not own:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{_name(refers_to)}>")]
    fields += [("X-Payload-Length", str(size)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _name(page) -> str:
    return "null" if page is None else str(page)


def parse(raw: bytes) -> dict:
    """Fields of one record, with ``payload`` (bytes; None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    out = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(out["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record of another length")
    out["payload"] = block.partition(b"\r\n\r\n")[2] if out["WARC-Type"] == "response" else None
    return out


# ------------------------------------------------------------ bundles
class Bundle:
    """Writes one file; ``add`` and ``close`` return places of finished records."""

    def __init__(self, folder: str, level: int):
        self.path = fresh(folder, ".warc.zst")
        files, local = opened(self.path)
        self.out = files.open_output_stream(local, compression=None)
        self.codec = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames, self.size, self.buffer, self.places = [], 0, [], []
        self.filled = 0

    def add(self, page, raw: bytes) -> list:
        self.places.append((page, self.filled, len(raw)))
        self.buffer.append(raw)
        self.filled += len(raw)
        return self.end_frame() if self.filled >= FRAME_BYTES else []

    def end_frame(self) -> list:
        if not self.buffer:
            return []
        packed = self.codec.compress(b"".join(self.buffer))
        self.out.write(packed)
        done = [(page, self.path, self.size, len(packed), at, n) for page, at, n in self.places]
        self.frames.append((len(packed), self.filled))
        self.size += len(packed)
        self.buffer, self.places, self.filled = [], [], 0
        return done

    def close(self) -> list:
        done = self.end_frame()
        table = b"".join(struct.pack("<2I", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<2I", SKIPPABLE, len(table)) + table)
        self.out.close()
        return done


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(place, packed bytes, bytes) of every frame, from a bundle's footer."""
    n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw, out, at = file.read_at(8 * n, size - 9 - 8 * n), [], 0
    for i in range(n):
        packed, whole = struct.unpack_from("<2I", raw, 8 * i)
        out.append((at, packed, whole))
        at += packed
    return out


def write_bundles(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write a record per row and return the index, a table in the same folder:
    (page, path, frame, frame_bytes, at, n_bytes).

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at
    least ``MIN_SHARED`` bytes the smallest page id is a response and the
    others revisit it; rows that share this id are all responses, a null id is
    larger than any other, and payloads whose ids are all null are responses.
    Smaller payloads are all responses. A null url has no target field; other
    columns are not carried.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    make_folder(folder)
    html = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].alias("page"), pages[url_col].cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    big = F.octet_length("html") >= MIN_SHARED
    shared = cut_lineage(rows.where(big).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > F.lit(total)
    busy = shared.where(is_hot).select("digest", F.col("first").alias("hot_first"))  # fewer than HOT rows
    # rows that are settled, or too small, keep off the shuffled keys
    key = F.when(big & F.col("hot_first").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("digest", "page", "url").cast("string")))
    cold = shared.where(~is_hot).select(F.col("digest").alias("key"), "first")
    known = rows.join(F.broadcast(busy), "digest", "left").withColumn("key", key).join(cold, "key", "left")
    known = known.select("page", "url", "html", "digest", F.coalesce(F.when(big, F.col("hot_first")), F.col("first")).alias("first"))

    def run(batches):
        bundle = None

        def table(done):
            cols = list(zip(*done)) if done else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page", "path", "frame", "frame_bytes", "at", "n_bytes"])

        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.string(), *[pa.int64()] * 4]
            done = []
            for part in pieces(batch, 2):
                for page, url, payload, digest, first in zip(*(c.to_pylist() for c in part.columns)):
                    bundle = bundle or Bundle(folder, level)
                    own = first is None or page == first
                    done += bundle.add(page, record(page, url, payload, digest, len(payload), first, own, date))
                    if bundle.size >= BUNDLE_BYTES:
                        done += bundle.close()
                        bundle = None
            yield table(done)
        if bundle:
            yield table(bundle.close())

    out = T.StructType([T.StructField("page", pages.schema[id_col].dataType), T.StructField("path", T.StringType()),
                        *[T.StructField(c, T.LongType()) for c in ("frame", "frame_bytes", "at", "n_bytes")]])
    known.mapInArrow(run, out).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_records(index: DataFrame) -> DataFrame:
    """Read the indexed records back, a frame at a time: (page, url, payload,
    payload_bytes, payload_digest, record_type, refers_to). Payloads are
    checked against their digests; a revisit has no payload but the size and
    digest of the full one."""
    kind = index.schema["page"].dataType
    cols = ["page", "path", "frame", "frame_bytes", "at", "n_bytes"]

    def run(batches):
        reader, here, frame = Reader(), None, b""
        unpack = zstandard.ZstdDecompressor()
        try:
            for batch in batches:
                got, size = [], 0
                for page, path, place, packed, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                    if (path, place) != here:
                        frame = unpack.decompress(reader.of(path).read_at(packed, place))
                        here = path, place
                    r = parse(frame[at:at + n])
                    payload = r["payload"]
                    digest = r["WARC-Payload-Digest"].removeprefix("sha256:")
                    if r["WARC-Record-ID"] != f"<urn:page:{_name(page)}>" or payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: a damaged record")
                    refers = r.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">") or None
                    got.append((page, r.get("WARC-Target-URI"), payload, int(r["X-Payload-Length"]) if payload is None else len(payload), digest, r["WARC-Type"], refers))
                    size += n
                    if size > 4 << 20:
                        yield table(got, batch.schema.field(0).type)
                        got, size = [], 0
                yield table(got, batch.schema.field(0).type)
        finally:
            reader.close()

    def table(got, page_type):
        columns = list(zip(*got)) if got else [()] * 7
        types = [page_type, pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=out.fieldNames()[:7])

    out = T.StructType([T.StructField("page", kind), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()),
                        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
                        T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType())])
    near = index.select(*cols).repartition("path", "frame").sortWithinPartitions("path", "frame", "at")
    return near.mapInArrow(run, out).withColumn("refers_to", F.col("refers_to").cast(kind))
