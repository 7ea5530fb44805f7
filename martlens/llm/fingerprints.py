"""Operator 2: document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; the top bits of the hash name a bin and
each bin keeps its minimum.  Empty bins borrow from a filled bin chosen by
optimal densification (a fixed random order of all bins per empty bin, first
filled one wins).  The low ``BITS`` of each bin are stored; likeness is the
share of equal bins, corrected for chance agreement of low bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, bound_batches, n_parts, read_docs, rows_to_batch, shingle_hashes

BINS, BITS = 256, 8
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
# place of bin j in the order in which empty bin i probes: one fixed random permutation per bin
_PROBE = np.argsort(np.random.default_rng(20240229).random((BINS, BINS)), axis=1).argsort(axis=1)


def fingerprint(shingles: np.ndarray) -> bytes:
    """Packed low bits of the densified bin minima; no shingles: no bytes."""
    if not len(shingles):
        return b""
    h = np.sort(shingles)
    first = np.searchsorted(h, _EDGES)
    nxt = np.append(first[1:], len(h))
    filled = np.flatnonzero(nxt > first)
    minima = np.zeros(BINS, np.uint64)
    minima[filled] = h[first[filled]]
    if len(filled) < BINS:
        empty = np.flatnonzero(nxt == first)
        minima[empty] = minima[filled[_PROBE[np.ix_(empty, filled)].argmin(axis=1)]]
    return (minima & np.uint64((1 << BITS) - 1)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1.

    Low bits of different minima agree by chance with probability 2**-BITS; the
    correction removes that.  Two empty texts: 1.  One empty text: 0."""
    if not a or not b:
        return float(a == b)
    same = float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))
    chance = 2.0 ** -BITS
    return min(1.0, max(0.0, (same - chance) / (1.0 - chance)))


def ordered_with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, guest, doc_id, text), sorted within partitions by doc_id, with whole buckets together.

    Buckets are ranges of doc_id.  Each also gets, as its last row (guest = 1),
    a copy of the first document of the next filled bucket, and the last one
    that of the first, so every document stands before its successor.  Texts
    are shuffled once.  The bounds are at most ``buckets`` numbers."""
    spark: SparkSession = docs.sparkSession
    bounds = sorted(set(docs.stat.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets))) \
        if buckets > 1 else []
    edges = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(edges, lambda e: e < F.col("doc_id"))), F.lit(0))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(bucket)
    rows = docs.withColumn("bucket", bucket)
    heads = (rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("h"))
             .select("bucket", "h.doc_id").orderBy("bucket").collect())  # one row per bucket
    if not heads:
        return rows.select("bucket", F.lit(0).alias("guest"), "doc_id", "text")
    before = [heads[i - 1]["bucket"] for i in range(len(heads))]
    guests = spark.createDataFrame([(h["doc_id"], b) for h, b in zip(heads, before)], "head long, bucket int")
    more = docs.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("head")))
    both = rows.select("bucket", F.lit(0).alias("guest"), "doc_id", "text").unionByName(
        more.select("bucket", F.lit(1).alias("guest"), "doc_id", "text"))
    return (both.withColumn("_h", F.xxhash64("text")).repartition(n_parts(spark), "bucket")
            .sortWithinPartitions("bucket", "guest", F.asc_nulls_first("doc_id"), "_h").drop("_h"))


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                 ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last floor(n/2) code points replaced by the first
    as many (or all) of the next document by ascending doc_id; the first
    follows the last.  Null text counts as empty; an empty text has the empty
    fingerprint.  A null doc_id sorts first; rows of one doc_id are ordered by a
    hash of their text; a single document follows itself.
    """

    def run(batches):
        cache = WordHashes()

        def made(text: str) -> bytes:
            return fingerprint(shingle_hashes(text.encode("utf-8"), cache))

        def row(doc, nxt):
            (doc_id, text, fp), (text2, fp2) = doc, nxt
            half = len(text) // 2
            edited = text[:len(text) - half] + text2[:half]
            efp = made(edited)
            return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), fp.hex(), efp.hex(),
                    likeness(fp, efp), likeness(fp, fp2))

        held, at = None, None
        for batch in batches:
            rows = []
            for bucket, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                if bucket != at:
                    held, at = None, bucket
                elif guest and held is None:
                    continue  # the successor of the last document has been seen
                text = text or ""
                fp = made(text)
                if held is not None:
                    rows.append(row(held, (text, fp)))
                held = None if guest else (doc_id, text, fp)
            if rows:
                yield rows_to_batch(rows, OUT)

    spark = docs.sparkSession
    bound_batches(spark)
    ordered = ordered_with_next(read_docs(docs, "doc_id", "text"), 2 * n_parts(spark))
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double")
