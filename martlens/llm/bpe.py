"""Operator 5: byte-level BPE by a global shuffle of distinct words.

1. Every task cuts its documents into blocks of bounded text.  A block lists
   its distinct pre-tokens once, and keeps each document as the sequence of
   numbers of its pre-tokens (the position is the place in the sequence).
2. The distinct words of all blocks are shuffled by word hash; each task
   encodes each distinct word of its share once, whichever blocks hold it.
3. The ids are joined back to the blocks, and every document's ids are put
   together by position.
4. Decoding joins the token-byte table (fixed size: one row per token).

A frequent word is one entry per block, not one per occurrence, so no hash
share grows with a word's frequency.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, n_parts, read_docs, texts_of
from .packing import bpe_encoder

BLOCK_BYTES = 40 << 20
_BIN = pa.binary()


def _z(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unz(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    return _z(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unz(blob), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def pack_strings(items: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, items), "<u4", len(items))
    return _z(np.array([len(items)], "<u4").tobytes() + lens.tobytes() + b"".join(items), 9)


def unpack_strings(blob: bytes) -> list[bytes]:
    raw = _unz(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)) + 4 + 4 * n
    starts = np.concatenate(([4 + 4 * n], ends[:-1])) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i]+lens[i]] for all i, one after the other."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    idx = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)
    return values[idx]


BLOCKS = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                    ("codes", _BIN), ("share_of", _BIN), ("words", pa.list_(_BIN))])


def pretoken_blocks(docs: DataFrame, pattern: str, shares: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: its documents as numbered pre-tokens and, per hash share, its distinct words."""

    def finish(doc_ids, counts, codes, numbers):
        flat = np.concatenate(codes) if codes else np.zeros(0, "<u4")
        # frequent words get small numbers; words of like frequency are in order, as that packs best
        scale = np.log2(np.maximum(np.bincount(flat, minlength=len(numbers)), 1)).astype(int).tolist()
        ranked = sorted((-c, w.encode("utf-8"), i) for i, (w, c) in enumerate(zip(numbers, scale)))
        renumber = np.empty(len(numbers), "<u4")
        renumber[[i for _, _, i in ranked]] = np.arange(len(numbers), dtype="<u4")
        words = [w for _, w, _ in ranked]
        share = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)) % np.uint64(shares)
        order = np.argsort(share, kind="stable")
        cuts = np.searchsorted(share[order], np.arange(shares + 1, dtype=np.uint64))
        lists = [pack_strings([words[i] for i in order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([doc_ids], pa.list_(pa.int64())),
             pa.array([counts], pa.list_(pa.int64())), pa.array([pack_numbers(renumber[flat])], _BIN),
             pa.array([pack_numbers(share.astype("<u4"))], _BIN), pa.array([lists], pa.list_(_BIN))], schema=BLOCKS)

    def run(batches):
        import regex

        find = regex.compile(pattern).finditer
        doc_ids, counts, codes, numbers, size = [], [], [], {}, 0
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                number = numbers.setdefault
                c = np.fromiter((number(m.group(), len(numbers)) for m in find(data.decode("utf-8"))), "<u4")
                doc_ids.append(doc_id)
                counts.append(len(c))
                codes.append(c)
                size += len(data) + 64
                if size >= block_bytes:
                    yield finish(doc_ids, counts, codes, numbers)
                    doc_ids, counts, codes, numbers, size = [], [], [], {}, 0
        if doc_ids:
            yield finish(doc_ids, counts, codes, numbers)

    return read_docs(docs, "doc_id", "text").mapInArrow(
        run, "block string, doc_ids array<long>, counts array<long>, codes binary, share_of binary, words array<binary>")


def encode_distinct(words: DataFrame, ranks_path: str) -> DataFrame:
    """(block, share, words) by share -> (block, share, ids): each distinct word of a share is encoded once.

    A share is the words whose hash falls into it; the number of shares grows
    with the input, so one task holds a bounded part of the vocabulary."""
    out = pa.schema([("block", pa.string()), ("share", pa.int32()), ("ids", _BIN)])

    def run(batches):
        enc = bpe_encoder(ranks_path, r"(?s:.+)")  # a pre-token is one piece
        share, known = None, {}
        for batch in batches:
            for block, s, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "share", "blob"))):
                if s != share:
                    share, known = s, {}
                words = unpack_strings(blob)
                new = [w for w in words if w not in known]
                known.update((w, np.array(enc.encode_ordinary(w.decode("utf-8")), dtype="<u4")) for w in new)
                ids = [known[w] for w in words]
                lens = np.fromiter(map(len, ids), "<u4", len(ids))
                flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
                raw = pack_numbers(np.concatenate((np.array([len(ids)], "<u4"), lens, flat)))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([s], pa.int32()), pa.array([raw], _BIN)], schema=out)

    spread = words.repartition(n_parts(words.sparkSession), "share").sortWithinPartitions("share")
    return spread.mapInArrow(run, "block string, share int, ids binary")


@functools.lru_cache(maxsize=1)
def token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table as (bytes, start of each id, length of each id)."""
    import base64

    with open(ranks_path, "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    toks = [table.get(i, b"") for i in range(max(table) + 1)]
    lens = np.fromiter(map(len, toks), np.int64, len(toks))
    return np.frombuffer(b"".join(toks), np.uint8), np.cumsum(lens) - lens, lens


def decode_ids(ids: np.ndarray, ranks_path: str) -> bytes:
    """Bytes of a sequence of ids, by the token-byte table, in bounded steps."""
    data, starts, lens = token_bytes(ranks_path)
    step = 1 << 20
    return b"".join(_ragged(data, starts[c], lens[c]).tobytes()
                    for c in (ids[i:i + step].astype(np.int64) for i in range(0, len(ids), step)))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = BLOCK_BYTES,
                     keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every document.

    Rows: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256; with ``keep_ids`` also ids (array) and decoded
    (string).  Null text counts as empty: no tokens.  Repeated rows and null
    ids are kept as they come; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shares = n_parts(spark)
    bound_batches(spark)
    blocks = cut_lineage(pretoken_blocks(docs, pattern, shares, block_bytes), "bpe-blocks")
    words = blocks.select("block", F.posexplode("words").alias("share", "blob"))
    ids = encode_distinct(words, ranks_path).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("share", "ids"))).alias("shares"))
    joined = blocks.select("block", "doc_ids", "counts", "codes", "share_of").join(ids, "block")
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())]
        ddl += ", ids array<long>, decoded string"
    out = pa.schema(fields)

    def assemble(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, counts, codes, share_of, shared = (
                    batch.column(c)[r].as_py() for c in ("doc_ids", "counts", "codes", "share_of", "shares"))
                lens, flat = [], []
                for s in shared:
                    raw = unpack_numbers(s["ids"])
                    n = int(raw[0])
                    lens.append(raw[1:1 + n].astype(np.int64))
                    flat.append(raw[1 + n:])
                lens, flat = np.concatenate(lens), np.concatenate(flat)
                order = np.argsort(unpack_numbers(share_of), kind="stable")  # the shares list words by number
                starts, sizes = np.empty_like(lens), np.empty_like(lens)
                starts[order], sizes[order] = np.cumsum(lens) - lens, lens
                codes = unpack_numbers(codes)
                cols, at = [[] for _ in fields], 0
                for doc_id, n in zip(doc_ids, counts):
                    c = codes[at:at + n]
                    at += n
                    ids = _ragged(flat, starts[c], sizes[c]).astype("<u4")
                    decoded = decode_ids(ids, ranks_path)
                    row = [doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    if keep_ids:
                        row += [ids.tolist(), decoded.decode("utf-8")]
                    for col, v in zip(cols, row):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    bound_batches(spark, rows=1)
    return joined.mapInArrow(assemble, ddl)
