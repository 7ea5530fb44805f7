"""Operator 12: groups of spelling variants by pivotal grams.

Two words one edit apart share grams: order the bigrams of all words by how
many words hold them, rarest first.  A word's prefix is its three first
positional bigrams (and one equal to the third that stands right after it).  Among the prefix two
disjoint bigrams of least total frequency, the pivots, are chosen by dynamic
programming.  One edit destroys at most one of two disjoint bigrams, so of two
near words the one whose prefix ends earlier in the order has a pivot that
stands in the other's prefix, at most one place away.  So only pivots are
looked up in an index of prefixes, with the places and lengths that one edit
allows; as the edit lies on one side of the pivot, the other side must agree.
What is found is verified.

The table of bigrams is bounded by the square of the alphabet, whatever the
corpus, and bounds what is sent to every task.  A bigram that many words have in
their prefixes is split into parts, each met by a copy of its pivots.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, read_docs, segments, texts_of

#: Letters of a word; only A-Z are put in lower case.
LETTERS = "A-Za-zÀ-ÿ"
_RUN = re.compile(f"[{LETTERS}]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: One edit: two pivots, three prefix grams.
PIVOTS, PREFIX = 2, 3
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words of one task's table before they are handed on; words of one part of a bigram's index.
HELD, PART = 200_000, 20_000
#: What one edit beside a pivot does: change of length, change of the pivot's place, and the side (0 left, 1 right) that stays whole.
MOVES = ((0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 1, 1), (-1, 0, 0), (-1, -1, 1))


def misspelt(doc_id: int | None, word: str) -> str:
    """The word, or without one letter if 97 divides the crc32 of ``<doc_id>:<word>`` (a null id is empty)."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n) of all words of LEAST_LENGTH letters and LEAST_COUNT occurrences; ``change`` may alter
    a document's word first.  Counted in each task and then by word, so a frequent word is a row a task."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        held: Counter[str] = Counter()

        def emit():
            words = [w for w in held if len(w) >= LEAST_LENGTH]
            for i in range(0, len(words), 50_000):
                some = words[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([held[w] for w in some], pa.int64())], schema=schema)
            held.clear()

        for b in batches:
            for doc_id, t in zip(b.column("doc_id").to_pylist(), texts_of(b)):
                for part in segments(t):  # cut at white space, never inside a word
                    for w, n in Counter(_RUN.findall(part.decode("utf-8").translate(_UPPER))).items():
                        held[w if change is None else change(doc_id, w)] += n
                if len(held) >= HELD:
                    yield from emit()
        yield from emit()

    bound_batches(docs.sparkSession)
    counted = read_docs(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def bigram_counts(words: DataFrame) -> DataFrame:
    """(gram, c): the number of places of every bigram of the distinct words; at most alphabet x alphabet rows."""
    schema = pa.schema([("gram", pa.string()), ("c", pa.int64())])

    def run(batches):
        held: Counter[str] = Counter()
        for b in batches:
            for w in b.column("word").to_pylist():
                held.update(map("".join, zip(w, w[1:])))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    return words.select("word").mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def choose_pivots(grams: list[tuple[int, int]], cost: Callable[[int], int], take: int = PIVOTS) -> list[tuple[int, int]]:
    """``take`` disjoint grams (place, number) of least total cost, by dynamic programming over the places."""
    grams = sorted(grams)
    # best[m][k]: (cost, chosen) of m disjoint grams among the first k
    best: list[list[tuple[int, tuple] | None]] = [[(0, ())] * (len(grams) + 1)]
    for m in range(1, take + 1):
        row: list[tuple[int, tuple] | None] = [None]
        before = 0  # how many grams end before this one begins
        for k, (at, g) in enumerate(grams):
            while grams[before][0] + 2 <= at:
                before += 1
            with_it = best[m - 1][before]
            now = None if with_it is None else (with_it[0] + cost(g), (*with_it[1], (at, g)))
            row.append(now if row[-1] is None or (now is not None and now[0] < row[-1][0]) else row[-1])
        best.append(row)
    return list(best[take][-1][1])


def prefix_and_pivots(word: str, rank: dict[str, int], cost: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """((place, rank) of the prefix, of the pivots, order of the prefix's last bigram).

    Bigrams are ordered by rank and place.  As an edit moves a bigram by one place, the prefix also
    takes one that equals its last and stands one place after it."""
    grams = [rank[x] for x in map("".join, zip(word, word[1:]))]
    first = [(at, g) for g, at in heapq.nsmallest(PREFIX, zip(grams, range(len(grams))))]
    at, last = first[-1]
    more = [(at + 1, last)] if at + 1 < len(grams) and grams[at + 1] == last else []
    return first + more, choose_pivots(first, cost.__getitem__), last << 32 | at


def near_links(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) with a < b of all pairs of words (word, n) exactly one edit apart."""
    spark = words.sparkSession
    # at most alphabet x alphabet rows: the letters of LETTERS in lower case are 90
    by_count = sorted((r["c"], r["gram"]) for r in bigram_counts(words).toLocalIterator())
    sent = spark.sparkContext.broadcast(({g: i for i, (_, g) in enumerate(by_count)}, [c for c, _ in by_count]))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("size", pa.int32()), ("last", pa.int64()), ("mask", pa.int64()),
                        ("prefix_at", pa.list_(pa.int32())), ("prefix_gram", pa.list_(pa.int32())),
                        ("pivot_at", pa.list_(pa.int32())), ("pivot_gram", pa.list_(pa.int32()))])

    def run(batches):
        rank, cost = sent.value
        for b in batches:
            rows = []
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                prefix, pivots, last = prefix_and_pivots(w, rank, cost)
                mask = 0
                for c in w:
                    mask |= 1 << (ord(c) * 37 % 63)
                rows.append((w, n, len(w), last, mask, *([x[k] for x in y] for y in (prefix, pivots) for k in (0, 1))))
            cols = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    bound_batches(spark, rows=10_000)
    grams = cut_lineage(words.mapInArrow(run, "word string, n long, size int, last long, mask long, prefix_at array<int>, "
                                              "prefix_gram array<int>, pivot_at array<int>, pivot_gram array<int>"), "spelling-grams")
    prefix = grams.select("word", "n", "size", "last", "mask", F.explode(F.arrays_zip("prefix_at", "prefix_gram")).alias("g"))
    # a row per bigram, so bounded as the bigrams are
    parts = prefix.groupBy(F.col("g.prefix_gram").alias("gram")).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    split = {r["gram"]: r["parts"] for r in parts.where(F.col("parts") > 1).toLocalIterator()}
    table = F.create_map(*[F.lit(x) for kv in split.items() for x in kv]) if split else None

    def sided(g: str, gram: str, at: str) -> list:
        """The gram's number, place and number of parts, and what stands on its left and right in the word."""
        number, place = F.col(f"{g}.{gram}"), F.col(f"{g}.{at}")
        return [number.alias("gram"), place.alias("at"), (F.lit(1) if table is None else F.coalesce(F.try_element_at(table, number), F.lit(1))).alias("parts"),
                F.array(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 3, F.col("size"))).alias("sides")]

    def key(at, size, side, part):
        return F.xxhash64("gram", at, size, side, F.get("sides", side), part).alias("key")

    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    index = prefix.select("word", "n", "size", "last", "mask", *sided("g", "prefix_gram", "prefix_at"), side).select(
        F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("last").alias("last_b"), F.col("mask").alias("mask_b"),
        key(F.col("at"), F.col("size"), F.col("side"), F.pmod(F.xxhash64("word"), F.col("parts"))))
    moves = F.array(*[F.struct(F.lit(d).alias("size"), F.lit(s).alias("at"), F.lit(k).alias("side")) for d, s, k in MOVES])
    probe = grams.select("word", "n", "size", "last", "mask", F.explode(F.arrays_zip("pivot_at", "pivot_gram")).alias("g")).select(
        "word", "n", "size", "last", "mask", *sided("g", "pivot_gram", "pivot_at"), F.explode(moves).alias("move")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part")).select(
        F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("last").alias("last_a"), F.col("mask").alias("mask_a"),
        key(F.col("at") + F.col("move.at"), F.col("size") + F.col("move.size"), F.col("move.side"), F.col("part")))
    # one edit changes the set of letters by two at most; verified inside the join, so only links leave it
    one_edit = ((F.col("last_a") <= F.col("last_b")) & (F.col("a") != F.col("b"))
                & (F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2) & (F.levenshtein("a", "b", 1) == 1))
    x, y = probe.alias("x"), index.alias("y")
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & one_edit).select("a", "n_a", "b", "n_b")
    up = F.col("a") < F.col("b")
    return found.select(F.least("a", "b").alias("a"), F.when(up, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
                        F.greatest("a", "b").alias("b"), F.when(up, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).distinct()


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form, following forms to the last.

    Counts at least double along a chain, so a chain has at most 63 steps and six rounds of jumping suffice."""
    jump = cut_lineage(forms.select("word", F.col("form").alias("root")), "spelling-jump")
    while True:
        up = jump.select(F.col("word").alias("via"), F.col("root").alias("next"))
        new = cut_lineage(jump.join(up, jump["root"] == up["via"], "left").select(
            "word", F.col("root").alias("old"), F.coalesce("next", "root").alias("root")), "spelling-jump")
        if new.where(F.col("old") != F.col("root")).isEmpty():
            return new.select("word", "root")
        jump = new.select("word", "root")


def spelling_variants(docs: DataFrame, change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of every distinct word of ``docs`` (doc_id, text).

    Words are runs of LETTERS in lower case, as ``change`` leaves them.  Near words differ by exactly one
    inserted, deleted or replaced letter.  A word's form is its near word of largest n (ties: smallest in
    code-point order) if that n is at least twice its own; the root ends the chain of forms.  Null and
    empty texts have no words; repeated rows count each; null ids and other columns need no care; an
    empty table gives no rows."""
    words = cut_lineage(word_counts(docs, change), "spelling-words")
    links = cut_lineage(near_links(words), "spelling-links")
    both = links.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionAll(
        links.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    judged = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.m") >= 2 * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f"),
    ).select("word", "n", "n_near", "f.form", "f.form_n"), "spelling-forms")
    roots = follow_forms(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
