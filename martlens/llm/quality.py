"""Operator 4: quality rules with risk-controlled thresholds.

Every rule rejects texts whose feature lies above a cutoff.  The cutoffs come
from labelled holdout documents: per stratum (language) and rule, cutoffs are
tested from the loosest on.  A cutoff is certified when the exact binomial
(Clopper-Pearson) upper bound of its false rejection rate, at confidence
``1 - delta / (rules x strata)``, is at most ``risk / rules``; the first that
fails ends the sequence.  So with probability ``1 - delta`` no stratum loses
more than ``risk`` of its good documents.  Among the certified cutoffs the one with most caught
bad texts for few lost good ones is used, the loosest on ties; without one the rule is off there.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (WordHashes, bound_batches, cut_lineage, mix64, read_docs, rows_to_batch, texts_of, word_hashes)

SYMBOLS = b"#*$%&|<>"
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "exclaim_ratio")
#: What the rate of lost good texts weighs against that of caught bad ones, among certified cutoffs.
GOOD_WEIGHT = 10.0
#: Candidate cutoffs of every rule, from the loosest to the tightest.
CUTOFFS = tuple(round(x / 50, 2) for x in range(49, 0, -1))
_SPACES = [0x20, *range(0x09, 0x0E)]


def repeat_words(w: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more in the sequence, the first included."""
    n = len(w)
    if n < 3:
        return 0
    h = mix64(mix64(mix64(w[:-2]) + w[1:-1]) + w[2:])
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    many = np.zeros(n - 2, bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= many
    covered[1:-1] |= many
    covered[2:] |= many
    return int(covered.sum())


def byte_counts(data: bytes) -> np.ndarray:
    total = np.zeros(256, np.int64)
    for i in range(0, len(data), 1 << 20):
        total += np.bincount(np.frombuffer(data, np.uint8, min(1 << 20, len(data) - i), i), minlength=256)
    return total


def text_metrics(data: bytes, cache: WordHashes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rule features."""
    w = word_hashes(data, cache)
    counts = byte_counts(data)
    chars = int(counts.sum() - counts[0x80:0xC0].sum() - counts[_SPACES].sum())
    symbols = int(counts[list(SYMBOLS)].sum())
    seen: set[bytes] = set()
    lines = dup = 0
    for line in data.split(b"\n"):
        if line.strip(b"\x20\x09\x0a\x0b\x0c\x0d"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    rep = repeat_words(w)
    letters = int(counts[0x41:0x5B].sum() + counts[0x61:0x7B].sum())
    return (len(w), chars, symbols, dup, rep, symbols / max(chars, 1), dup / max(lines, 1), rep / max(len(w), 1),
            int(counts[0x41:0x5B].sum()) / max(letters, 1), int(counts[0x21]) / max(len(w), 1))


def metrics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per document: base counts and rule features of its whole text (null: no words)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *[(n, pa.int64()) for n in names],
                     *[(r, pa.float64()) for r in RULES]])

    def run(batches):
        cache = WordHashes()
        for b in batches:
            yield rows_to_batch([(i, s, *text_metrics(t, cache)) for i, s, t in zip(
                b.column("doc_id").to_pylist(), b.column("stratum").to_pylist(), texts_of(b))], out)

    bound_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"), F.col("text"))
    return src.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{n} long" for n in names) + ", "
                          + ", ".join(f"{r} double" for r in RULES))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny)
    f = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return f


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly (as an incomplete beta function)."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, p) / b


def certified(k: int, n: int, risk: float, delta: float) -> bool:
    """The Clopper-Pearson upper bound of k rejections in n at confidence 1 - delta is at most ``risk``."""
    return n > 0 and k < n * risk and binomial_cdf(k, n, risk) <= delta


#: What is certified: the rejection by all rules of one set together, the rules of a set at one cutoff.
RULE_SETS = tuple(c for n in range(1, len(RULES) + 1) for c in itertools.combinations(RULES, n))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> tuple[float, float | None]:
    """(gain, cutoff) of a set of rules from its counts by place of the first cutoff that rejects.

    Cutoffs are tested from the loosest on, each at ``delta``, until one is not certified (fixed sequence);
    of the certified ones that with the greatest gain is taken, the loosest of equals."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    best: tuple[float, float | None] = (0.0, None)
    for i, cutoff in enumerate(CUTOFFS):
        lost, caught = int(good[:i + 1].sum()), int(bad[:i + 1].sum())
        if not certified(lost, n_good, risk, delta):
            break
        gain = caught / max(n_bad, 1) - GOOD_WEIGHT * lost / max(n_good, 1)
        if gain > best[0] + 1e-12:
            best = (gain, cutoff)
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """(stratum, rule, cutoff): the certified cutoffs; empty where the holdout is too small.

    A stratum gets the set of rules of greatest gain.  The risk bounds what the set rejects together, so
    it is not divided over rules; the error ``delta`` is divided over all sets in all strata.
    Labelled rows with null doc_id or quality are no holdout; several labels of
    one document count once, as good if any says so."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    held = measured.where(~F.col("base_failed")).join(marked, "doc_id")
    # place of the first (loosest) cutoff below the feature; past the end: never rejected
    places = held.select("stratum", "quality", *[sum((F.col(r) <= c).cast("int") for c in CUTOFFS).alias(r) for r in RULES])
    sets = F.array(*[F.struct(F.lit(k).alias("k"), (F.least(*c) if len(c) > 1 else F.col(c[0])).alias("at")) for k, c in enumerate(RULE_SETS)])
    binned = places.select("stratum", "quality", F.explode(sets).alias("x")).groupBy("stratum", "x.k", "x.at").agg(
        # at most sets x (cutoffs + 1) rows per stratum
        F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("quality") != 1, 1)).alias("bad"))
    strata = binned.agg(F.countDistinct("stratum")).scalar()

    def choose(key, rows):
        import pandas as pd

        good = np.bincount(rows["at"], rows["good"], minlength=len(CUTOFFS) + 1)
        bad = np.bincount(rows["at"], rows["bad"], minlength=len(CUTOFFS) + 1)
        gain, cutoff = choose_cutoff(good, bad, risk, delta / (len(RULE_SETS) * int(rows["strata"].iloc[0])))
        return pd.DataFrame({"stratum": [key[0]], "k": [key[1]], "gain": [gain], "cutoff": [cutoff]})

    certain = binned.withColumn("strata", strata).groupBy("stratum", "k").applyInPandas(
        choose, "stratum string, k int, gain double, cutoff double").where(F.col("cutoff").isNotNull())
    # of equal gains the set of fewest rules
    best = certain.groupBy("stratum").agg(F.min(F.struct((-F.col("gain")).alias("g"), "k", "cutoff")).alias("b"))
    names = F.array(*[F.array(*[F.lit(r) for r in c]) for c in RULE_SETS])
    return best.select("stratum", F.explode(F.get(names, F.col("b.k"))).alias("rule"), F.col("b.cutoff").alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05,
                  stratum: str = "lang") -> DataFrame:
    """Base counts, base_failed and kept of every document, and the rules that reject it.

    Null text has no words and fails the base.  A null stratum is a stratum of
    its own.  A stratum without enough labelled documents keeps all that pass
    the base.  Repeated rows are judged each; an empty table gives no rows.
    """
    m = cut_lineage(metrics(docs, stratum).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "quality")
    wide = cutoffs(m, labels, risk, delta).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    wide = wide.select("stratum", *[F.col(r).alias(f"_{r}") for r in RULES])
    judged = m.join(wide, "stratum", "left").withColumn("rejected_by", F.filter(F.array(*[
        F.when(F.col(r) > F.col(f"_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull()))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"),
                         F.concat_ws(",", "rejected_by").alias("rejected_by"))
