"""Operator 6: monolithic gzip normaliser for WARC archives.

``write_monolithic`` writes one archive per task as a single gzip stream.
``normalise`` inflates such a stream once, from start to end, rewrites every
record as a gzip member of its own and writes a sidecar index of offsets.
``read_indexed`` reads the records back by the index, one member at a time.

Files go to a folder that all executors share, through ``pyarrow.fs`` (local
shared folders, HDFS, S3, GCS).  File names are unique per task attempt, and
only the names that finished tasks report are read, so a lost executor or a
repeated attempt leaves no half-written archive in use.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import bound_batches, cut_lineage, shared_fs

MIN_REVISIT_BYTES = 100
#: One date for all records, so equal inputs give equal archives.
RECORD_DATE = "1970-01-01T00:00:00Z"
LEVEL = 1
FILE_BYTES = 256 << 20
_CHUNK = 1 << 20
_MAX_HEAD = 64 << 20


def record_id(page_id: int | None, serial: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{serial}>"


def _clean(value: str) -> str:
    return "".join(c for c in value if c not in "\r\n")


def record_bytes(kind: str, rid: str, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    body = b"" if kind == "revisit" else payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {RECORD_DATE}",
            f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers is not None:
        head += [f"WARC-Refers-To: {refers}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """records (page_id, url, html, payload_digest, record_type, refers_to) -> one row per archive: path.

    Each task streams its records into single-stream .warc.gz files of bounded size."""

    def run(batches):
        fs, root = shared_fs(folder)
        out, packer, path, size = None, None, None, 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")]
            for page_id, url, payload, digest, kind, refers in zip(*cols):
                if out is None:
                    path = f"{root}/mono-{uuid.uuid4().hex}.warc.gz"
                    out, packer, size = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, wbits=31), 0
                rec = record_bytes(kind, record_id(page_id, uuid.uuid4().hex), url, payload or b"", digest,
                                   None if refers is None else record_id(refers, digest))
                out.write(packer.compress(rec))
                size += len(rec)
                if size >= FILE_BYTES:
                    out.write(packer.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path]})
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return records.mapInArrow(run, "path string")


def inflated(source):
    """Bytes of a gzip stream (any number of members) in pieces of at most one chunk, however well it packs.

    A stream that ends inside a member is an error, also between two records."""
    unzip = None
    while raw := source.read(_CHUNK):
        while raw:
            unzip = unzip or zlib.decompressobj(31)
            piece = unzip.decompress(raw, _CHUNK)
            raw = unzip.unconsumed_tail
            if unzip.eof:
                raw, unzip = unzip.unused_data, None
            if piece:
                yield piece
    while unzip is not None and not unzip.eof:
        piece = unzip.decompress(unzip.unconsumed_tail, _CHUNK)
        if not piece and not unzip.eof:
            raise ValueError("the archive ends inside a gzip member")
        if piece:
            yield piece


def stream_records(source):
    """Inflates a gzip stream once and yields (head, record, payload) of each record.

    Memory is bounded by one record and one chunk; 64 MB without the end of a head are an error."""
    buf, need = bytearray(), 0
    for piece in inflated(source):
        buf += piece
        pos = 0
        while len(buf) - pos >= need:
            end = buf.find(b"\r\n\r\n", pos)
            if end < 0:
                if len(buf) - pos > _MAX_HEAD:
                    raise ValueError("not a WARC record")
                break
            head = parse_head(bytes(buf[pos:end]))
            stop = end + 4 + int(head["content-length"])
            if len(buf) < stop + 4:
                need = stop + 4 - pos
                break
            yield head, bytes(buf[pos:stop + 4]), bytes(buf[end + 4:stop])
            pos, need = stop + 4, 0
        del buf[:pos]
    if buf:
        raise ValueError("the archive ends inside a record")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """path of monolithic archives -> one row per rewritten archive: path, index_path, n_records.

    Every record becomes its own gzip member; the sidecar (one JSON object a
    line: offset, length, id, type) lets any record be read alone."""
    schema = pa.schema([("path", pa.string()), ("index_path", pa.string()), ("n_records", pa.int64())])

    def run(batches):
        fs, root = shared_fs(folder)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                name = f"{root}/norm-{uuid.uuid4().hex}.warc.gz"
                offset = n = 0
                with fs.open_input_stream(source, compression=None) as src, \
                        fs.open_output_stream(name, compression=None) as out, \
                        fs.open_output_stream(name + ".idx", compression=None) as idx:
                    for head, record, _ in stream_records(src):
                        packer = zlib.compressobj(LEVEL, wbits=31)
                        member = packer.compress(record) + packer.flush()
                        out.write(member)
                        idx.write((json.dumps({"offset": offset, "length": len(member), "id": head["warc-record-id"],
                                               "type": head["warc-type"]}) + "\n").encode())
                        offset += len(member)
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([name + ".idx"]), pa.array([n], pa.int64())],
                                                 schema=schema)

    return archives.mapInArrow(run, "path string, index_path string, n_records long")


READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                  ("body_bytes", pa.int64()), ("body_digest", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])


def read_indexed(archives: DataFrame, folder: str) -> DataFrame:
    """Reads every record by its index entry and checks it against its own digest."""

    def page_of(rid: str) -> int | None:
        name = rid.strip("<>").split(":")[2]
        return None if name == "null" else int(name)

    def run(batches):
        fs, _ = shared_fs(folder)
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist()):
                rows = []
                with fs.open_input_file(path) as f, fs.open_input_stream(index, compression=None) as idx:
                    import io

                    for line in io.BufferedReader(idx, _CHUNK):
                        e = json.loads(line)
                        f.seek(e["offset"])
                        raw = zlib.decompress(f.read(e["length"]), 31)
                        end = raw.find(b"\r\n\r\n")
                        head = parse_head(raw[:end])
                        body = raw[end + 4:end + 4 + int(head["content-length"])]
                        refers = head.get("warc-refers-to")
                        rows.append((page_of(head["warc-record-id"]), head["warc-type"],
                                     head["warc-payload-digest"].removeprefix("sha256:"), len(body),
                                     hashlib.sha256(body).hexdigest(), page_of(refers) if refers else None,
                                     head.get("warc-target-uri", "")))
                        if len(rows) >= 4096:
                            yield _read_batch(rows)
                            rows = []
                if rows:
                    yield _read_batch(rows)

    return archives.mapInArrow(run, "page_id long, record_type string, payload_digest string, body_bytes long, "
                                    "body_digest string, refers_to long, target_uri string")


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ)], schema=READ)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds payload (binary), payload_digest, record_type and refers_to.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the
    response (every row of it, if its row is repeated), the others revisit it.
    A null page_id is never the smallest unless all are null.  Only digests
    that occur twice or more, one row each, are joined back."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                     F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256))
    firsts = (p.where(F.octet_length("payload") >= min_bytes).groupBy("payload_digest")
              .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .where((F.col("_n") > 1) & F.col("_first").isNotNull()).select("payload_digest", "_first"))
    j = p.join(firsts, "payload_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return j.select("page_id", "url", "payload", "payload_digest",
                    F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
                    F.when(revisit, F.col("_first")).alias("refers_to"))


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages as monolithic archives, normalises them and reads the records back.

    Rows: page_id, payload_bytes, payload_digest, record_type, refers_to.  Null
    html is an empty payload, null url an empty target; repeated rows each give
    a record; an empty table gives no archive and no rows.  A revisit has no
    body: its size is that of the response it refers to.
    """
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    fs, root = shared_fs(folder)
    fs.create_dir(root, recursive=True)
    bound_batches(spark)
    mono = cut_lineage(write_monolithic(with_revisits(pages), folder), "warc-mono")
    bound_batches(spark, rows=1)
    norm = cut_lineage(normalise(mono.repartition(max(1, mono.count())), folder), "warc-norm")
    read = cut_lineage(read_indexed(norm.repartition(max(1, norm.count())), folder), "warc-read")
    size = (read.where((F.col("record_type") == "response") & (F.col("body_digest") == F.col("payload_digest")))
            .groupBy("payload_digest").agg(F.max("body_bytes").alias("_bytes")))
    revisits = read.where(F.col("record_type") == "revisit").join(size, "payload_digest", "left")
    cols = ["page_id", "payload_digest", "record_type", "refers_to"]
    both = read.where(F.col("record_type") != "revisit").select(
        *cols, F.col("body_bytes").alias("payload_bytes"), F.col("body_digest").alias("_digest")).unionByName(
        revisits.select(*cols, F.col("_bytes").alias("payload_bytes"), F.col("payload_digest").alias("_digest")))
    return both.select("page_id", "payload_bytes", F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
