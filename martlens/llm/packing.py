"""Operator 1: best-fit packing (best-two-fit) of tokenised documents into fixed-length sequences.

A sequence starts with the longest unpacked piece and is filled greedily with
the longest piece that still fits.  Then its smallest piece is taken out again
if two unpacked pieces fit the expanded gap more tightly.

Pieces of one length are interchangeable, so the choice depends only on how
many pieces of each length are left.  That table has one row per length (at
most ``capacity`` rows, whatever the corpus), so the plan is made once for the
whole corpus on the driver, and every sequence layout is repeated as often as
its lengths last.  Texts and pieces never leave Spark: each piece gets its
rank among the pieces of its length (rank inside its task, plus a running
total over tasks) and looks its place up in the plan.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, read_docs, rows_to_batch, texts_of

CAPACITY = 2048
SEPARATOR = 0


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Text -> id of the added tokens of a tokenizers JSON; they are cut out of a text before it is split."""
    with open(tokenizer_path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{tokenizer_path}: an added token is not matched as it stands")
    return {a["content"]: a["id"] for a in added}


@functools.lru_cache(maxsize=2)
def bpe_encoder(ranks_path: str, pattern: str):
    """The public ranks file as an encoder, with the added tokens of the JSON beside it; built once per worker.

    ``encode(text, allowed_special="all")`` gives the ids of the tokenizers library on that JSON with
    add_special_tokens=False, at less than half its CPU time; ``encode_ordinary`` knows no added token."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                             special_tokens=added_tokens(str(Path(ranks_path).with_suffix(".json"))))


#: Blank runs of this length are left to the tokenizers library: the backtracking of the other encoder is bounded.
_LONG_BLANK = re.compile(r"(?<!\s)\s{10000}")


@functools.lru_cache(maxsize=2)
def json_encoder(ranks_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(Path(ranks_path).with_suffix(".json")))


def token_ids(text: str, ranks_path: str, pattern: str) -> list[int]:
    """The ids of the tokenizers library, add_special_tokens=False, for any text."""
    if _LONG_BLANK.search(text):
        return json_encoder(ranks_path).encode(text, add_special_tokens=False).ids
    return bpe_encoder(ranks_path, pattern).encode(text, allowed_special="all")


def piece_spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; a remainder goes first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def plan_layouts(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit over a length histogram: [(copies, [(length, times), ...]), ...].

    Each step finds the layout the sequential algorithm would choose next and
    repeats it as long as its pieces last."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, c in counts.items():
        left[length] = c
    layouts = []

    def floors() -> np.ndarray:
        idx = np.where(left > 0, np.arange(capacity + 1), 0)
        return np.maximum.accumulate(idx)

    while left.any():
        seed = int(np.flatnonzero(left)[-1])
        used: list[int] = []
        gap = capacity
        piece = seed
        while piece:
            used.append(piece)
            left[piece] -= 1
            gap -= piece
            low = left[:gap + 1].nonzero()[0]
            piece = int(low[-1]) if len(low) else 0
        if gap and len(used) > 1:
            small = used[-1]
            room = gap + small
            fl = floors()
            xs = np.flatnonzero(left[:room])
            if len(xs):
                ys = fl[room - xs]
                single = (ys == xs) & (left[xs] < 2)
                ys = np.where(single, fl[np.maximum(xs - 1, 0)], ys)
                total = np.where(ys > 0, xs + ys, 0)
                best = int(total.argmax())
                if total[best] > small:
                    left[small] += 1
                    used[-1:] = [int(xs[best]), int(ys[best])]
                    left[xs[best]] -= 1
                    left[ys[best]] -= 1
        times: dict[int, int] = {}
        for u in used:
            times[u] = times.get(u, 0) + 1
        more = min(int(left[u]) // t for u, t in times.items())
        for u, t in times.items():
            left[u] -= more * t
        layouts.append((more + 1, sorted(times.items(), reverse=True)))
    return layouts


def _slots(layouts: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, dict[str, np.ndarray]]:
    """Per length: the runs of ranks, each with its layout's first sequence, copies and offset."""
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for copies, items in layouts:
        offset = 0
        for length, t in items:
            first = seen.get(length, 0)
            by.setdefault(length, []).append((first, base, copies, offset))
            seen[length] = first + t * copies
            offset += t * length
        base += copies
    return {k: {n: np.array(c, dtype=np.int64) for n, c in zip(("first", "base", "copies", "offset"), zip(*v))}
            for k, v in by.items()}


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("_task", pa.int32()), ("_local", pa.int64())])


def tokenised_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, with the task and the rank
    among the pieces of its length there."""

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = np.array(token_ids(data.decode("utf-8"), ranks_path, pattern) + [SEPARATOR], dtype="<u4")
                for k, (s, n) in enumerate(piece_spans(len(ids), capacity)):
                    local = seen.get(n, 0)
                    seen[n] = local + 1
                    rows.append((doc_id, k, s, n, zlib.crc32(ids[s:s + n].tobytes()), task, local))
            yield rows_to_batch(rows, PIECES)

    bound_batches(docs.sparkSession)
    return read_docs(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _local long")


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    Rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null or empty text is a document of the separator only.  Repeated rows are
    packed once each; null doc_id stays null; an empty table gives no rows.
    Strings of added tokens in a text (<|endoftext|>) get their own id.
    """
    pieces = cut_lineage(tokenised_pieces(docs, ranks_path, pattern, capacity), "pieces")
    per_task = pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per length: at most `capacity` rows, whatever the corpus
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(_slots(plan_layouts(counts, capacity)))
    out = pa.schema([*[PIECES.field(i) for i in range(5)], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                s, at = slots.value[int(n)], np.flatnonzero(length == n)
                i = np.searchsorted(s["first"], rank[at], side="right") - 1
                q = rank[at] - s["first"][i]
                seq[at] = s["base"][i] + q % s["copies"][i]
                off[at] = s["offset"][i] + q // s["copies"][i] * n
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(seq), pa.array(off)], schema=out)

    bound_batches(docs.sparkSession, rows=10_000)
    ranked = pieces.join(starts, ["length", "_task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_local")).alias("_rank"))
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
