"""Shared helpers of the training-data operators: bounded Arrow batches, word
hashes, shingle hashes, column hygiene and lineage cuts."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

__all__ = ["cut_lineage", "bound_batches", "read_docs", "free_name", "packed", "unpacked", "join_counted", "texts_of", "WordHashes", "word_hashes", "mix64",
           "shingle_hashes", "rows_to_batch", "n_parts"]

#: Words separate on these six bytes only (they never occur inside a UTF-8 multi-byte character).
SPACE = rb"[\x20\x09-\x0D]"
_SPACE_RE = re.compile(SPACE)
_SEGMENT = 1 << 22
_CACHE_WORDS = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F], dtype=np.uint64)


_SHIPPED: set[str] = set()


def shared_fs(folder: str):
    """(filesystem, path) of a folder URI in the shared store."""
    from pyarrow import fs

    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once, so that they can import it
    wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ship-{uuid.uuid4().hex}"
    fs, path = shared_fs(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{root.name}.zip", compression=None) as out:
        out.write(data.getvalue())
    sc.addPyFile(f"{folder}/{root.name}.zip")
    _SHIPPED.add(sc.applicationId)


def bound_batches(spark: SparkSession, rows: int = 256, mb: int = 16) -> None:
    """Arrow batches of bounded rows and bytes, so a run of long texts stays small in a worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once (zstd Parquet) under the shared checkpoint folder and reads it back, so a
    lost executor recomputes from the table and never from what made it."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_docs(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so extra columns of any name cannot clash with derived ones."""
    return docs.select(*[F.col(f"`{c}`") for c in cols])


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores behind it as no column of ``df`` (whatever its case) has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, spread: Sequence[str], parts: int = 1000) -> DataFrame:
    """Inner join of rows with a table of one row per ``key`` that says in ``n`` how many rows hold it.

    A key that holds more than one in ``parts`` of those rows is split by a hash of the columns ``spread``, and its
    row of the table is copied to every part.  At most ``parts`` keys are, so naming them to every task is bounded."""
    total = table.agg(F.sum(n)).scalar()
    sized = cut_lineage(table.withColumn("_parts", F.ceil(F.col(n) * parts / total).cast("int")), "counted")
    split = sized.where(F.col("_parts") > 1).select(key, "_parts")
    part = F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(split), key, "left").withColumn("_part", part).drop("_parts")
    copies = sized.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and, as one struct ``rest``, all other columns, so that none of them clashes with a derived one."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("rest"))


def unpacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that ``packed`` was given, in their order."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in columns])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x if x is not None else b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash, remembered for frequent words; emptied when it reaches a fixed size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def segments(data: bytes) -> Iterator[bytes]:
    """Cuts a long text at white space, so word lists stay bounded whatever its length."""
    at = 0
    while len(data) - at > _SEGMENT:
        m = _SPACE_RE.search(data, at + _SEGMENT)
        end = m.start() if m else len(data)
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def word_hashes(data: bytes, cache: WordHashes) -> np.ndarray:
    """64-bit hash of each word, in order."""
    parts = []
    for seg in segments(data):
        words = seg.split()
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(data: bytes, cache: WordHashes, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles of a text with A-Z in lower case, repeats included.

    Fewer words than k: the whole sequence as one shingle.  No words: none."""
    w = word_hashes(data.lower(), cache)
    n = len(w)
    if n == 0:
        return w
    size = min(k, n)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = mix64(h + w[i:n - size + 1 + i]) if i >= len(_ODD) else h + w[i:n - size + 1 + i] * _ODD[i]
    return mix64(h)


def rows_to_batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)
