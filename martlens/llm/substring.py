"""Operator 10: substring deduplication by De Bruijn compaction.

Token k-mers are the edges of the graph.  Of every window of ``WINDOW`` words
only the k-mer with the least hash (leftmost on ties) is kept, so the graph has
a few per cent of all k-mers, every window holds one of them, and equal windows
hold the same one at the same place.

1. k-mers are counted over the corpus and the counts joined to their source
   coordinates; a window can only be repeated if its k-mer is.
2. Two neighbouring repeated k-mers form a link, identified by all words from
   the first to the end of the second.  A link is nonbranching if it occurs
   exactly as often as both of its k-mers.  Chains of nonbranching links
   compact to paths: every occurrence of one of their k-mers lies on the whole
   path, so a window inside a path is repeated and needs no further check.
3. Windows at the ends and branches of paths are verified by their source
   coordinates: the hash of all their words is counted over the corpus.

Only texts that hold a repeated k-mer are read again.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import WordHashes, bound_batches, cut_lineage, join_counted, mix64, packed, texts_of, unpacked, word_hashes

WINDOW, K = 35, 8
_PER = WINDOW - K + 1
_CHUNK = 1 << 18
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POW, _UNPOW = _powers(_BASE, _CHUNK + 2 * WINDOW), _powers(_INV, _CHUNK + 2 * WINDOW)


def _prefix(w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * _POW[:len(w)], out=out[1:])
    return out


def _spans(prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hash of the words [start, start + length), the same wherever they stand."""
    size = np.uint64(length) if isinstance(length, int) else length.astype(np.uint64)
    return mix64((prefix[start + length] - prefix[start]) * _UNPOW[start] + size)


def chunks(w: np.ndarray):
    """(offset, prefix, number of windows) for runs of windows of bounded length; all windows of a text."""
    n = len(w) - WINDOW + 1
    for at in range(0, max(n, 0), _CHUNK):
        m = min(_CHUNK, n - at)
        yield at, _prefix(w[at:at + m + WINDOW - 1]), m


def anchors_of(prefix: np.ndarray, m: int) -> np.ndarray:
    """For each of m windows the place of its k-mer: the least hash, leftmost on ties."""
    place = np.arange(m + _PER - 1)
    h = _spans(prefix, place, K)
    low = np.uint64(20)
    key = (h >> low << low) | place.astype(np.uint64)
    size = 1
    while size * 2 <= _PER:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    rest = _PER - size
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    return (key & np.uint64((1 << 20) - 1)).astype(np.int64)


def graph_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, k-mer hashes, link hashes) of a text; the link goes to the next place, the last is 0."""
    if len(w) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.unique(np.concatenate([np.unique(anchors_of(p, m)) + at for at, p, m in chunks(w)]))
    kmers, links = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
    step = _CHUNK
    for at in range(0, len(w), step):  # a span is at most WINDOW + K words long and starts in this step
        i, j = np.searchsorted(places, [at, at + step])
        if i == j:
            continue
        p = _prefix(w[at:at + step + 2 * WINDOW - 1])
        kmers[i:j] = _spans(p, places[i:j] - at, K)
        e = min(j, len(places) - 1)
        if e > i:
            links[i:e] = _spans(p, places[i:e] - at, places[i + 1:e + 1] + K - places[i:e])
    return places, kmers.view(np.int64), links.view(np.int64)


def kept_words(data: bytes, removed: np.ndarray) -> tuple[int, str]:
    """(number of removed words, SHA-256 of the kept words joined by one space)."""
    h, i, first = hashlib.sha256(), 0, True
    for m in _WORD.finditer(data):
        if not removed[i]:
            h.update(m.group() if first else b" " + m.group())
            first = False
        i += 1
    return int(removed.sum()), h.hexdigest()


def without(data: bytes, removed: np.ndarray) -> bytes:
    """The text without the removed words; each removed run goes with the space after it."""
    out, at, i, cutting = [], 0, 0, False
    for m in _WORD.finditer(data):
        if removed[i] and not cutting:
            out.append(data[at:m.start()])
            cutting = True
        elif cutting and not removed[i]:
            at, cutting = m.start(), False
        i += 1
    return b"".join(out) if cutting else b"".join(out) + data[at:]


def _keyed(docs: DataFrame, cols: list[str]) -> DataFrame:
    """Names a row by its id and a hash of its text; repeated rows share a name and are treated alike."""
    return docs.select(*[F.col(f"`{c}`") for c in cols], F.coalesce(F.col("doc_id"), F.lit(-1)).alias("_d"),
                       F.xxhash64("doc_id", "text").alias("_k"))


def graph(docs: DataFrame) -> DataFrame:
    """(doc_id, _d, _k, n_words, all_sha, at, kmer, link), one row per document."""
    out = pa.schema([("doc_id", pa.int64()), ("_d", pa.int64()), ("_k", pa.int64()), ("n_words", pa.int64()), ("all_sha", pa.string()),
                     ("at", pa.list_(pa.int64())), ("kmer", pa.list_(pa.int64())), ("link", pa.list_(pa.int64()))])

    def run(batches):
        cache = WordHashes()
        for b in batches:
            n, sha, at, kmer, link = [], [], [], [], []
            for t in texts_of(b):
                w = word_hashes(t, cache)
                p, k, x = graph_of(w)
                n.append(len(w))
                sha.append(hashlib.sha256(b" ".join(t.split())).hexdigest())
                at.append(p)
                kmer.append(k)
                link.append(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_d"), b.column("_k"), pa.array(n, pa.int64()), pa.array(sha), *[
                pa.array(c, pa.list_(pa.int64())) for c in (at, kmer, link)]], schema=out)

    bound_batches(docs.sparkSession)
    return _keyed(docs, ["doc_id", "text"]).mapInArrow(
        run, "doc_id long, _d long, _k long, n_words long, all_sha string, at array<long>, kmer array<long>, link array<long>")


def compact(g: DataFrame) -> DataFrame:
    """(_d, _k, at, runs): per text with repeated k-mers their places and the path runs (start, end)."""
    edges = g.select("_d", "_k", F.posexplode(F.transform(F.arrays_zip("at", "kmer", "link"), lambda e, i: F.struct(
        e["at"].alias("at"), e["kmer"].alias("kmer"), e["link"].alias("link"), F.get("kmer", i + 1).alias("next"),
        F.get("at", i + 1).alias("to")))).alias("ord", "e")).select("_d", "_k", "ord", "e.*")
    counts = cut_lineage(edges.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "dbg-kmers")
    rep = cut_lineage(join_counted(edges, counts, "kmer", "n", ["_d", "_k", "ord"]), "dbg-edges")
    links = rep.where(F.col("to").isNotNull()).groupBy("link", "kmer", "next", "n").agg(F.count(F.lit(1)).alias("c")) \
        .where((F.col("c") == F.col("n")) & (F.col("c") > 1))
    ends = counts.select(F.col("kmer").alias("next"), F.col("n").alias("n_next"))
    straight = links.join(ends, "next").where(F.col("c") == F.col("n_next")).groupBy("link").agg(
        F.sum("c").alias("c"))
    on_path = join_counted(rep.where(F.col("to").isNotNull()), straight, "link", "c", ["_d", "_k", "ord"]).select("_d", "_k", "ord", "at", "to").distinct()
    island = F.col("ord") - F.row_number().over(Window.partitionBy("_d", "_k").orderBy("ord"))
    runs = on_path.withColumn("island", island).groupBy("_d", "_k", "island").agg(
        F.min("at").alias("start"), (F.max("to") + K).alias("end")).groupBy("_d", "_k").agg(
        F.collect_list(F.struct("start", "end")).alias("runs"))
    places = rep.groupBy("_d", "_k").agg(F.collect_set("at").alias("at"))
    return places.join(runs, ["_d", "_k"], "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start:bigint,end:bigint>>")))


def open_windows(docs: DataFrame, info: DataFrame, carry: list[str], all_rows: bool) -> DataFrame:
    """The rows of texts with repeated k-mers (with ``all_rows``: all rows) with ``proven``, the path
    runs, and ``at``/``hash``, the windows that are still to be verified."""
    src = _keyed(docs, [*dict.fromkeys([*carry, "text"])]).join(info, ["_d", "_k"], "left" if all_rows else "inner")
    longs = ArrayType(LongType())
    schema = StructType([f for f in src.schema.fields if f.name not in ("at", "runs")] + [
        StructField("_from", longs), StructField("_to", longs), StructField("_at", longs), StructField("_hash", longs)])
    names = [f.name for f in schema.fields]

    def run(batches):
        cache = WordHashes()
        for b in batches:
            cols = [[], [], [], []]
            for t, rep, runs in zip(texts_of(b), b.column("at").to_pylist(), b.column("runs").to_pylist()):
                start = end = at = h = None
                if rep is not None:
                    w = word_hashes(t, cache)
                    rep = np.unique(np.array(rep, np.int64))
                    runs = sorted({(r["start"], r["end"]) for r in runs})
                    start, end = np.array([r[0] for r in runs], np.int64), np.array([r[1] for r in runs], np.int64)
                    ats, hs = [], []
                    for off, prefix, m in chunks(w):
                        i = np.arange(m)
                        open_ = np.isin(anchors_of(prefix, m) + off, rep, assume_unique=False)
                        if len(start):
                            r = np.searchsorted(start, i + off, side="right") - 1
                            open_ &= ~((r >= 0) & (end[np.maximum(r, 0)] >= i + off + WINDOW))
                        i = i[open_]
                        ats.append(i + off)
                        hs.append(_spans(prefix, i, WINDOW))
                    at = np.concatenate(ats) if ats else np.zeros(0, np.int64)
                    h = np.concatenate(hs).view(np.int64) if hs else at
                for c, v in zip(cols, (start, end, at, h)):
                    c.append(v)
            own = [b.column(x) for x in names[:-4]]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, pa.list_(pa.int64())) for c in cols]], names=names)

    bound_batches(docs.sparkSession, rows=64)
    return src.mapInArrow(run, schema)


def _removed(n: int, start, end, at) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    for s, e in zip(start, end):
        if e - s >= WINDOW:
            mark[s] += 1
            mark[e] -= 1
    for s in at or ():
        mark[s] += 1
        mark[s + WINDOW] -= 1
    return np.cumsum(mark[:-1]) > 0


def _verified(open_: DataFrame) -> DataFrame:
    """(_d, _k, _starts): windows whose words occur at two places or more."""
    w = open_.select("_d", "_k", F.explode(F.arrays_zip("_at", "_hash")).alias("x")).select("_d", "_k", "x._at", "x._hash")
    many = w.groupBy("_hash").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    return join_counted(w, many, "_hash", "c", ["_d", "_k", "_at"]).groupBy("_d", "_k").agg(F.collect_set("_at").alias("_starts"))


def substring_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    Removes each word covered by a window of 35 words that also starts anywhere
    else.  Null text has no words.  Repeated rows repeat each other's windows;
    texts of fewer than 35 words keep all; an empty table gives no rows.
    """
    g = cut_lineage(graph(docs), "dbg-graph")
    info = cut_lineage(compact(g), "dbg-paths")
    open_ = cut_lineage(open_windows(docs, info, ["doc_id"], all_rows=False), "dbg-open")
    rows = open_.select("doc_id", "_d", "_k", "text", "_from", "_to").join(_verified(open_), ["_d", "_k"], "left")
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            n, gone, sha = [], [], []
            for t, s, e, at in zip(texts_of(b), *(b.column(c).to_pylist() for c in ("_from", "_to", "_starts"))):
                words = sum(1 for _ in _WORD.finditer(t))
                r, d = kept_words(t, _removed(words, s, e, at))
                n.append(words)
                gone.append(r)
                sha.append(d)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], schema=out)

    changed = rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    rest = g.join(info.select("_d", "_k"), ["_d", "_k"], "left_anti")
    ids = rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("all_sha").alias("kept_sha256"))
    return changed.unionByName(ids)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The same columns and rows, each text without its repeated passages (n_chars follows, where there is one)."""
    names = docs.columns
    docs, n_chars = packed(docs), docs.schema["n_chars"].dataType if "n_chars" in names else None
    g = cut_lineage(graph(docs), "dbg-graph")
    info = cut_lineage(compact(g), "dbg-paths")
    rows = cut_lineage(open_windows(docs, info, docs.columns, all_rows=True), "dbg-open")
    todo = rows.where(F.col("_from").isNotNull())
    joined = todo.drop("_at", "_hash").join(_verified(todo), ["_d", "_k"], "left").select("doc_id", "text", "rest", "_from", "_to", "_starts")

    def run(batches):
        for b in batches:
            texts = []
            for t, s, e, at in zip(texts_of(b), *(b.column(c).to_pylist() for c in ("_from", "_to", "_starts"))):
                gone = _removed(sum(1 for _ in _WORD.finditer(t)), s, e, at)
                texts.append(without(t, gone).decode("utf-8") if gone.any() else t.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("rest")], names=["doc_id", "text", "rest"])

    changed = unpacked(joined.mapInArrow(run, docs.schema), names)
    if n_chars is not None:
        changed = changed.withColumn("n_chars", F.length("text").cast(n_chars))
    return unpacked(rows.where(F.col("_from").isNull()), names).unionByName(changed)
