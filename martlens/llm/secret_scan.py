"""Operator 7: secret scans by two character Markov models (DataFrame functions only).

Base patterns find assignments, access keys and hex runs.  The method adds
further spans: every run of key characters, or what base spans leave of one, is scored by the log-likelihood
ratio of two first-order Markov models over ASCII characters, one of random
strings and one of ordinary identifiers, both trained from labelled samples.
The models are one table of at most 128 x 128 character pairs, read as a
scalar; texts are never shuffled.

Higher-order functions evaluate a column again wherever its expression stands, so what is
used more than once is bound first (``bound``), and every step is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, free_name

#: The base patterns, in the order in which kinds are listed, and the least length of what must be long.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE, MIN_ACCESS = 6, 20
#: What the method judges: runs of key characters of this length and more.
MIN_RUN = 8
KEY = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{KEY})({KEY}{{{MIN_RUN},}}+)"
#: The same where base spans stand: they are taken whole, and a run ends where one begins.
_LONG_BASE = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{{MIN_VALUE},}}+|AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}+|{HEX}+"""
BETWEEN = rf"{_LONG_BASE}|((?:(?!{_LONG_BASE}){KEY})++)"
#: Items of one step of a running sum, so that no array is grown item by item over a long text.
BLOCK = 64
SPAN = "array<struct<start:int,end:int,value:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def before(items: Column, size: Callable[[Column], Column], op: Callable[[Column, Column], Column]) -> Column:
    """For every item the sum (or another associative ``op`` with 0 as its unit) of the sizes of those before it.

    By blocks: totals of blocks, their running totals, and the places inside each block."""
    def of(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: op(a, size(x))))

        def inside(b, first):
            zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(b, zero, lambda a, x: F.struct(
                op(a["at"], size(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

        return bound(totals, lambda t: F.flatten(F.transform(blocks, lambda b, j: inside(
            b, F.aggregate(F.slice(t, F.lit(1), j), F.lit(0), lambda a, x: op(a, x))))))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")),
                      lambda j: F.slice(items, j * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(items) > 0, bound(cut, of)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, value); code points, end exclusive.

    ``split`` gives the gaps between the matches, so starts are running sums of
    lengths; texts without a match skip all that.  ``value`` is the group's text."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    vals = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    both = F.arrays_zip(F.split(text, pattern, -1).alias("g"), hits.alias("h"), vals.alias("v"))
    steps = F.transform(F.filter(both, lambda x: x["h"].isNotNull()), lambda x: F.struct(
        F.length(x["g"]).alias("gap"), F.length(x["h"]).alias("len"), x["v"].alias("value")))

    def spans(s):
        ends = before(s, lambda x: x["gap"] + x["len"], lambda a, b: a + b)
        return F.zip_with(s, ends, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("end"),
                                                          x["value"].alias("value")))

    return F.when(text.rlike(pattern), bound(steps, spans)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """(assign, access, hex): the matches of each base kind that are long enough."""
    return F.struct(F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= MIN_VALUE).alias("assign"),
                    F.filter(matches(text, ACCESS), lambda x: F.length(x["value"]) >= MIN_ACCESS).alias("access"),
                    matches(text, HEX).alias("hex"))


def key_runs(text: Column, has_base: Column) -> Column:
    """Runs of MIN_RUN and more key characters outside base spans, as (start, end, value)."""
    runs = F.when(has_base, matches(text, BETWEEN, 1)).otherwise(matches(text, CANDIDATE, 1))
    return F.filter(runs, lambda x: F.length(x["value"]) >= MIN_RUN)


def labelled_samples(docs: DataFrame, labels: DataFrame, ordinary_docs: int = 2000) -> DataFrame:
    """(value, random): strings that the base patterns mark as secrets, from all documents, and the
    key-character runs of at most ``ordinary_docs`` documents labelled good (those with the smallest hash)
    that hold no base match.  Ordinary runs count in lower and in upper case as well."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = text.rlike(f"{ASSIGN}|{ACCESS}|{HEX}")
    secret = docs.where(some).select(base_spans(text).alias("b")).select(
        F.explode(F.concat("b.assign", "b.access", "b.hex")).alias("x")).select(F.col("x.value").alias("value"), F.lit(True).alias("random"))
    good = (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(ordinary_docs))
    words = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id").where(~some).select(
        F.explode(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(1))).alias("w"))
    plain = words.select(F.explode(F.array(F.col("w"), F.lower("w"), F.upper("w"))).alias("value"), F.lit(False).alias("random"))
    return secret.unionByName(plain)


def codes_of(value: Column) -> Column:
    """The ASCII codes of a string, others as 127."""
    return F.transform(F.split(value, ""), lambda c: F.least(F.ascii(c), F.lit(127)))


def train(samples: DataFrame, weight: float = 20.0) -> DataFrame:
    """One row: ratio, the log-likelihood ratio of each character pair (index 128 * first + second).

    The next character given the last backs off with ``weight`` pairs to the frequency of the
    character; for random strings half of that is uniform over the key alphabet, as samples
    never show all alphabets.  Without samples of both kinds all ratios are 0."""
    codes = samples.where(F.length("value") >= 2).select("random", bound(codes_of(F.col("value")), lambda c: F.arrays_zip(
        F.slice(c, F.lit(1), F.size(c) - 1).alias("a"), F.slice(c, F.lit(2), F.size(c)).alias("b"))).alias("p"))
    pairs = codes.select("random", F.explode("p").alias("p"))
    # at most 128 * 128 rows, written because they are read four times
    counts = cut_lineage(pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(
        F.count(F.when(F.col("random"), 1)).alias("r"), F.count(F.when(~F.col("random"), 1)).alias("o")), "secret-pairs")
    firsts = counts.groupBy("a").agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"))
    seconds = counts.groupBy("b").agg(F.sum("r").alias("rb"), F.sum("o").alias("ob"))
    whole = counts.agg(F.sum("r").alias("r"), F.sum("o").alias("o")).select(F.struct("r", "o")).scalar()
    grid = samples.sparkSession.range(128 * 128).select("id", (F.col("id") / 128).cast("int").alias("a"), (F.col("id") % 128).cast("int").alias("b"))
    g = grid.join(counts, ["a", "b"], "left").join(firsts, "a", "left").join(seconds, "b", "left").fillna(0).withColumn("_all", whole)
    alphabet = 66.0
    r_b = 0.5 / alphabet + 0.5 * F.col("rb") / F.col("_all.r")
    o_b = (F.col("ob") + 0.5) / (F.col("_all.o") + 0.5 * alphabet)
    ratio = (F.log((F.col("r") + weight * r_b) / (F.col("ra") + weight)) - F.log((F.col("o") + weight * o_b) / (F.col("oa") + weight)))
    v = F.when((F.col("_all.r") > 0) & (F.col("_all.o") > 0), ratio).otherwise(0.0)
    return g.select(F.struct("id", v.alias("v")).alias("x")).agg(
        F.transform(F.sort_array(F.collect_list("x")), lambda x: F.coalesce(x["v"], F.lit(0.0))).alias("ratio"))


def score(value: Column, ratio: Column) -> Column:
    """Log-likelihood ratio of a string, summed over its character pairs."""
    return bound(codes_of(value), lambda c: F.aggregate(
        F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.element_at(ratio, a * 128 + b + 1)),
        F.lit(0.0), lambda t, x: t + x))


def found_spans(text: Column, ratio: Column, margin: float, floor: float) -> Column:
    """(base, spans): arrays of (start, rank, end, kind), sorted; spans holds the base ones too.

    A run is added if its ratio exceeds ``floor`` (a chance of e^-floor for an ordinary run) and
    ``margin`` per character pair."""
    def kind(col, rank):
        return F.transform(col, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
                                                   F.lit(KINDS[rank]).alias("kind")))

    def judged(base):
        runs = key_runs(text, F.size(base) > 0)
        random = F.filter(runs, lambda x: score(x["value"], ratio) > F.greatest(F.lit(floor), margin * (F.length(x["value"]) - 1)))
        every = F.array_sort(F.concat(base, kind(random, 3)))

        def apart(spans):  # a base span of one kind may reach beyond one of another kind into a run
            reach = before(spans, lambda x: F.when(x["kind"] != KINDS[3], x["end"]).otherwise(0), F.greatest)
            return F.transform(F.filter(F.arrays_zip(spans.alias("s"), reach.alias("r")), lambda x: (
                x["s"]["kind"] != KINDS[3]) | (x["s"]["start"] >= x["r"])), lambda x: x["s"])

        return F.struct(base.alias("base"), bound(every, lambda e: F.when(F.size(base) > 0, apart(e)).otherwise(e)).alias("spans"))

    def sorted_base(b):
        return F.array_sort(F.concat(kind(b["assign"], 0), kind(b["access"], 1), kind(b["hex"], 2)))

    return bound(base_spans(text), lambda b: bound(sorted_base(b), judged))


def scan(docs: DataFrame, labels: DataFrame, use: Callable[[Column, Column], Column], keep: list[str], out: str,
         margin: float = 0.25, floor: float = 16.0, ordinary_docs: int = 2000) -> DataFrame:
    """The columns ``keep`` and ``out``: what ``use`` makes of the text and its spans, a struct (base, spans) of
    arrays of (start, rank, end, kind), sorted.

    Null text counts as empty; no labels or no base matches: no added spans;
    rows are judged one by one, so repeated rows and null ids need no care; an
    empty table gives no rows.  A span of the method overlaps no base span."""
    model = cut_lineage(train(labelled_samples(docs, labels, ordinary_docs)), "secret-model")
    text = F.coalesce(F.col("text"), F.lit(""))
    table = free_name(docs, "ratio")
    made = bound(found_spans(text, F.col(table), margin, floor), lambda s: use(text, s))
    return docs.withColumn(table, model.select("ratio").scalar()).select(*[F.col(f"`{c}`") for c in keep], made.alias(out))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def secret_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document; see scan()."""
    def report(text, s):
        def count(k):
            return F.size(F.filter(s["base"], lambda x: x["kind"] == k)).cast("long")

        return F.struct(*[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(s["base"]).cast("binary"), 256).alias("base_sha256"),
                        joined(s["spans"]).alias("spans"))

    return scan(docs, labels, report, ["doc_id"], "r").select("doc_id", "r.*")


def redact(docs: DataFrame, labels: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same columns and rows, each text with its secrets replaced by ``mark``.

    Overlapping spans get one mark each, the later ones over what is left of them."""
    def cut(text, s):
        spans = s["spans"]
        reach = before(spans, lambda x: x["end"], F.greatest)

        def pieces(r):
            kept = F.zip_with(spans, r, lambda x, at: F.when(x["start"] >= at, F.concat(
                F.substring(text, at + 1, x["start"] - at), F.lit(mark))).otherwise(F.lit("")))
            end = F.array_max(F.transform(spans, lambda x: x["end"]))
            return F.concat(F.array_join(kept, ""), F.substring(text, end + 1, F.length(text)))

        return F.when(F.size(spans) > 0, bound(reach, pieces)).otherwise(text)

    out = free_name(docs, "text")
    made = scan(docs, labels, cut, docs.columns, out)
    return made.select(*[F.when(F.col("text").isNotNull(), F.col(out)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
