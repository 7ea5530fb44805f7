"""Review text jobs.

Per-row work is JVM-side expressions (regex cleaning, array higher-order
functions); the lexicon is a caller-given table turned into one broadcast
map row, so scoring a comment needs no shuffle at all.  Token statistics
explode tokens and aggregate with map-side combining; per-class top-k is
salted so no class lands whole in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.columns import month_label
from ..functions.text import (
    BOOSTER_DECREMENT, BOOSTER_INCREMENT, BOOSTERS_DOWN, BOOSTERS_UP, NEGATION_SCALAR, NEGATORS,
    NORMALIZE_ALPHA, clean_text, sentiment_class, words,
)
from ..session import cut_lineage
from .kernels import top_k_per_group

LEXICON_MAX_TERMS = 1_000_000


def clean_reviews(reviews: DataFrame, min_len: int = 5, lang: str | None = None) -> DataFrame:
    """N1 + N2 (+ N13): cleaned comment, rows whose cleaned length exceeds ``min_len``;
    ``lang`` optionally keeps one language (the code this mirrors has no such filter)."""
    r = reviews
    if lang is not None:
        r = r.where(F.col("lang") == lang)
    # exploding the filtered one-element array keeps the regex chain to one evaluation per row (a plain
    # filter would be pushed below the projection and run the chain again)
    long_enough = F.filter(F.array(clean_text(F.col("review_comment_message"))), lambda t: F.length(t) > min_len)
    return r.select("*", F.explode(long_enough).alias("clean_comment"))


def english_modifiers(spark) -> DataFrame:
    """The fixed English boosters and negators as a table (term, boost, negator)."""
    return spark.createDataFrame([(w, BOOSTER_INCREMENT, False) for w in BOOSTERS_UP] + [(w, BOOSTER_DECREMENT, False) for w in BOOSTERS_DOWN]
                                 + [(w, 0.0, True) for w in NEGATORS], "term string, boost double, negator boolean")


def word_table(lexicon: DataFrame, modifiers: DataFrame | None = None) -> DataFrame:
    """(term, lv, b, ng): lexicon valence (null when absent), booster value and
    negator flag for every word that has any of them.  ``modifiers`` is a table
    (term, boost, negator); the fixed English one when not given."""
    spark = lexicon.sparkSession
    lex = lexicon.select(F.col("term"), F.col("valence").cast("double").alias("lv"),
                         F.lit(0.0).alias("b"), F.lit(False).alias("ng"))
    mods = modifiers if modifiers is not None else english_modifiers(spark)
    fx = mods.select("term", F.lit(None).cast("double").alias("lv"), F.col("boost").alias("b"), F.col("negator").alias("ng"))
    return lex.unionByName(fx).groupBy("term").agg(
        F.max("lv").alias("lv"), F.sum("b").alias("b"), F.max(F.col("ng").cast("int")).cast("boolean").alias("ng"))


def corpus_lexicon(df: DataFrame, text: str = "clean_comment") -> DataFrame:
    """(term, valence) of two thirds of the distinct tokens of a corpus, valences by letter and length:
    a word table that grows with the corpus."""
    term = df.select(F.explode(words(F.col(text))).alias("term")).where(F.length("term") > 1).distinct()
    k = F.ascii("term") + F.length("term")
    return term.where(k % 3 != 0).select("term", ((k * 7 % 41 - 20) / 10).alias("valence"))


def word_lookup_row(words_t: DataFrame, n: int) -> DataFrame:
    """One row holding a word table of n words as a hash-bucketed array (bucket =
    pmod(hash(term), nb)), so a token lookup is one hash and a scan of a
    bucket of ~1 entry instead of a linear scan of a map."""
    nb = 1
    while nb < max(n, 1):
        nb *= 2
    keyed = words_t.withColumn("_b", F.pmod(F.hash("term"), F.lit(nb)))
    grouped = keyed.groupBy("_b").agg(F.collect_list(F.struct("term", "lv", "b", "ng")).alias("_e"))
    slots = words_t.agg(F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("_b"))
    dense = slots.join(grouped, "_b", "left").agg(
        F.sort_array(F.collect_list(F.struct("_b", "_e"))).alias("_s"))
    return dense.select(F.transform("_s", lambda x: x["_e"]).alias("_wb"), F.lit(nb).alias("_nb"))


def _look_back(valence: Column, before) -> Column:
    """The running valence after the three tokens before it; ``before(distance)`` is (term, lv, b, ng) or null."""
    # the running valence and each token before are bound once; spelled out they would be evaluated 27 times and more
    steps = F.array(*[F.struct(before(dist).alias("p"), F.lit(damp).alias("damp")) for dist, damp in ((1, 1.0), (2, 0.95), (3, 0.9))])

    def step(v, s):
        p = s["p"]
        boost = F.coalesce(p["b"], F.lit(0.0)) * s["damp"]
        turned = (v + F.when(v < 0, -boost).otherwise(boost)) * F.when(
            F.coalesce(p["ng"], F.lit(False)), F.lit(NEGATION_SCALAR)).otherwise(F.lit(1.0))
        return F.when(p["lv"].isNull(), turned).otherwise(v)

    return F.aggregate(steps, valence, step)


def _weighed(v: Column, pos: Column, but_at: Column) -> Column:
    """Half before the contrast word (1-based place, 0 when absent), one and a half after it."""
    return F.when((but_at > 0) & (pos < but_at), v * 0.5).when((but_at > 0) & (pos > but_at), v * 1.5).otherwise(v)


def _compound(total: Column) -> Column:
    comp = total / F.sqrt(total * total + F.lit(NORMALIZE_ALPHA))
    comp = F.round(F.least(F.greatest(comp, F.lit(-1.0)), F.lit(1.0)), 4)
    return F.when(total.isNull() | (comp == 0), F.lit(0.0)).otherwise(comp)  # no -0.0


def lexicon_sentiment(df: DataFrame, lexicon: DataFrame, text: str = "clean_comment",
                      out: str = "sentiment_score", modifiers: DataFrame | None = None, contrast: str = "but",
                      max_broadcast: int = LEXICON_MAX_TERMS) -> DataFrame:
    """Compound score in [-1, 1] per text.

    Tokens are blank-separated words longer than one letter.  A token in the
    lexicon (and not itself a booster) starts at its valence; each of the
    three tokens before it that is not in the lexicon adds its booster value
    (sign of the running valence; x0.95 at distance 2, x0.9 at 3) and, if it
    is a negator, multiplies the running valence by -0.74.  Valences before the
    first 'but' are halved, after it x1.5.  Sum x -> x / sqrt(x^2 + 15),
    clipped, 4 decimals.  Empty text -> 0.

    A word table of at most ``max_broadcast`` words rides along as one broadcast row, without a
    shuffle; a larger one is joined to the distinct tokens (see token_facts).  Scores are the same.
    Of a ``df`` made by text_blocks() the column _block is dropped.
    """
    words_t = cut_lineage(word_table(lexicon, modifiers), "word-table")
    n = words_t.count()
    toks = F.filter(words(F.col(text)), lambda w: F.length(w) > 1)
    if n > max_broadcast:
        return _score_by_join(df, words_t, text, toks, out, contrast)
    # The one-row, size-checked word table rides along as a broadcast (fetched
    # once per executor); as a scalar literal it would be serialised into every
    # task.  One row on the build side: no pairs are formed.
    d = df.crossJoin(F.broadcast(word_lookup_row(words_t, n))).withColumn("_tok", toks)
    wb, nb = F.col("_wb"), F.col("_nb")

    def lookup(w):
        bucket = F.element_at(wb, F.pmod(F.hash(w), nb) + 1)
        return F.get(F.filter(bucket, lambda e: e["term"] == w), 0)

    # one lookup per token: struct(term, lv, b, ng) or null
    d = d.withColumn("_f", F.transform("_tok", lookup))
    # first 'but' (1-based, 0 when absent), computed once per text, not per token
    d = d.withColumn("_but", F.array_position(F.col("_tok"), contrast))
    f, but_at = F.col("_f"), F.col("_but")

    def scored(x, i):
        # the look-back runs only for lexicon words that are not boosters
        v = F.when(x["lv"].isNotNull() & (F.coalesce(x["b"], F.lit(0.0)) == 0), _look_back(x["lv"], lambda dist: F.get(f, i - dist))) \
            .otherwise(F.lit(0.0))
        return _weighed(v, i + 1, but_at)

    total = F.aggregate(F.transform(f, scored), F.lit(0.0), lambda acc, x: acc + x)
    return d.withColumn(out, _compound(total)).drop("_wb", "_nb", "_tok", "_f", "_but", "_block")


#: Bytes of neighbouring texts whose distinct words are looked up together.
BLOCK_BYTES = 16 << 20
#: Bytes of text whose tokens lie in a task's memory at a time.
SLICE_BYTES = 4 << 20
#: A token that holds more than one in so many of all rows is split into parts, each with its own copy of the word's row.
TOKEN_PARTS = 1000


def text_blocks(df: DataFrame, text: str = "clean_comment") -> DataFrame:
    """``df`` written once, with the column _block: the number of a run of neighbouring rows with about BLOCK_BYTES of text."""
    schema = StructType([*df.schema.fields, StructField("_block", LongType())])
    size = BLOCK_BYTES

    def numbered(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        first, before = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + (ends - n) // size)], names=schema.fieldNames())
            before = int(ends[-1]) if len(ends) else before

    return cut_lineage(df.mapInArrow(numbered, schema), "sentiment-rows", "zstd")


def token_facts(tokens: DataFrame, words_t: DataFrame) -> DataFrame:
    """``tokens`` (_block, _w) with the (lv, b, ng) of their word, those without one left out.

    Distinct tokens are joined once to the word table by shuffle; both sides are unique, so no key is
    hot.  Their rows go back to the blocks, a frequent token in parts: a part holds at most one
    in TOKEN_PARTS of all rows, so at most TOKEN_PARTS tokens have parts and that table can be broadcast."""
    counts = tokens.groupBy("_w").agg(F.count(F.lit(1)).alias("_c"))
    counts = cut_lineage(counts, "token-counts")
    total = counts.agg(F.sum("_c")).scalar()
    known = cut_lineage(counts.join(words_t, counts["_w"] == words_t["term"]).select(
        "_w", "lv", "b", "ng", F.ceil(F.col("_c") * TOKEN_PARTS / total).cast("int").alias("_parts")), "token-words")
    split = known.where(F.col("_parts") > 1).select("_w", "_parts")
    part = F.pmod(F.xxhash64("_block"), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = tokens.join(F.broadcast(split), "_w", "left").withColumn("_part", part).drop("_parts")
    copies = known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copies, ["_w", "_part"]).drop("_part")


def _score_by_join(df: DataFrame, words_t: DataFrame, text: str, toks: Column, out: str, contrast: str) -> DataFrame:
    """lexicon_sentiment() with the word table joined by shuffle.

    A block's distinct words are joined, not its tokens: a row per token, with its text and place, would be shuffled on the
    way to its word and back, several times the texts.  Here the texts are shuffled once, to the known words of their block."""
    rows = df if "_block" in df.columns else text_blocks(df, text)  # written, so the block numbers stay what they are
    tokens = cut_lineage(rows.select("_block", F.explode(F.array_distinct(toks)).alias("_w")).distinct(), "block-words", "zstd")
    facts = token_facts(tokens, words_t).select("_block", "_w", "lv", "b", "ng")
    # each block lies together, its words before its texts
    met = rows.unionByName(facts.withColumnsRenamed({"lv": "_lv", "b": "_b", "ng": "_ng"}), allowMissingColumns=True)
    met = met.repartition("_block").sortWithinPartitions("_block", F.col("_w").isNull())
    keep = [c for c in rows.columns if c != "_block"]
    schema = StructType([*(rows.schema[c] for c in keep), StructField("_total", DoubleType())])
    scored = met.mapInArrow(_block_totals(keep, text, contrast, schema.fieldNames()), schema)
    return scored.withColumn(out, _compound(F.col("_total"))).drop("_total")


def _block_totals(keep: Sequence[str], text: str, contrast: str, names: Sequence[str]):
    """The function of Arrow batches that gives every text the sum of its valences: the rules of lexicon_sentiment(), on
    all tokens of a slice of texts at once, each sum taken in the order of the tokens."""
    slice_bytes, negated = SLICE_BYTES, NEGATION_SCALAR

    def totals(texts, words, inside, lv, boost, negates):
        """Sums of an array of texts; whether a word is in the lexicon, its valence, its booster value and whether it negates
        have one place more than ``words``, which is that of an unknown word."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.split_pattern(texts, " ")
        of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        tok = lists.flatten()
        long = pc.greater(pc.utf8_length(tok), 1)
        tok, of = tok.filter(long), of[long.to_numpy(zero_copy_only=False)]
        word = pc.fill_null(pc.index_in(tok, value_set=words), len(words)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(inside[word] & (boost[word] == 0))
        v = lv[word[at]]
        for dist, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
            back = np.maximum(at - dist, 0)
            same = (at >= dist) & (of[back] == of[at])
            p = np.where(same, word[back], len(words))
            up = boost[p] * damp
            turned = (v + np.where(v < 0, -up, up)) * np.where(negates[p], negated, 1.0)
            v = np.where(inside[p], v, turned)
        first = np.full(len(texts), -1)
        turns = np.flatnonzero(pc.equal(tok, pa.scalar(contrast, tok.type)).to_numpy(zero_copy_only=False))[::-1]
        first[of[turns]] = turns  # the first one is put last
        turn = first[of[at]]
        v = np.where((turn >= 0) & (at < turn), v * 0.5, np.where((turn >= 0) & (at > turn), v * 1.5, v))
        return np.bincount(of[at], weights=v, minlength=len(texts))  # adds in the order of the tokens

    def table(parts):
        import pyarrow as pa

        t = pa.Table.from_batches(parts).combine_chunks() if parts else None

        def values(name, unknown, kind):
            known = [] if t is None else [unknown if x is None else x for x in t.column(name).to_pylist()]
            return np.array([*known, unknown], dtype=kind)

        words = pa.array([], pa.string()) if t is None else t.column("_w").combine_chunks()
        inside = [] if t is None else t.column("_lv").is_valid().to_pylist()
        return words, np.array([*inside, False]), values("_lv", 0.0, float), values("_b", 0.0, float), values("_ng", False, bool)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        block, parts, facts = None, [], None
        for batch in batches:
            at = batch.column("_block").to_numpy(zero_copy_only=False)
            entry = batch.column("_w").is_valid().to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            share = (np.cumsum(size) - size) // slice_bytes
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (entry[1:] != entry[:-1]) | (share[1:] != share[:-1])) + 1), len(at)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if at[lo] != block:
                    block, parts, facts = at[lo], [], None
                piece = batch.slice(lo, hi - lo)
                if entry[lo]:
                    parts.append(piece.select(["_w", "_lv", "_b", "_ng"]))
                    continue
                facts = facts or table(parts)
                sums = totals(piece.column(text), *facts)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(sums, pa.float64())], names=names)

    return run


def filter_stopwords(df: DataFrame, text: str = "clean_comment", out: str = "filtered_text",
                     min_len: int = 3) -> DataFrame:
    """Words not in the stopword list (hash-set lookups in the JVM
    transformer) and at least ``min_len`` letters, joined by blanks."""
    from pyspark.ml.feature import StopWordsRemover

    from ..functions.text import DOMAIN_STOPWORDS, ENGLISH_STOPWORDS

    rm = StopWordsRemover(inputCol="_words", outputCol="_kept", caseSensitive=True,
                          stopWords=ENGLISH_STOPWORDS + DOMAIN_STOPWORDS)
    w = rm.transform(df.withColumn("_words", words(F.col(text))))
    kept = F.filter(F.col("_kept"), lambda x: F.length(x) >= min_len)
    return w.withColumn(out, F.array_join(kept, " ")).drop("_words", "_kept")


def review_sentiment(reviews: DataFrame, lexicon: DataFrame, lang: str | None = None) -> DataFrame:
    """Cleaned, scored, classed and stopword-filtered comments."""
    c = clean_reviews(reviews, lang=lang)
    s = lexicon_sentiment(c, lexicon)
    s = s.withColumn("sentiment", sentiment_class(F.col("sentiment_score")))
    return filter_stopwords(s)


def sentiment_by_score(scored: DataFrame) -> DataFrame:
    """Mean sentiment per star rating, 3 decimals half-even (exact 4-decimal sums)."""
    s = F.sum(F.col("sentiment_score").cast("decimal(12,4)")).cast("double") / F.count(F.lit(1))
    return scored.groupBy("review_score").agg(F.bround(s, 3).alias("avg_sentiment")).orderBy("review_score")


def score_counts(reviews: DataFrame) -> DataFrame:
    """Reviews per star rating over all reviews, ascending."""
    return (reviews.where(F.col("review_score").isNotNull()).groupBy("review_score")
            .agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy("review_score"))


def sentiment_by_month(scored: DataFrame) -> DataFrame:
    """Mean sentiment per review month (null month dropped)."""
    s = F.sum(F.col("sentiment_score").cast("decimal(12,4)")).cast("double") / F.count(F.lit(1))
    m = scored.where(F.col("review_creation_date").isNotNull())
    return m.groupBy(month_label("review_creation_date").alias("month")).agg(F.round(s, 6).alias("avg_sentiment"))


def term_counts(scored: DataFrame, text: str = "filtered_text", by: str | None = "sentiment") -> DataFrame:
    """Token counts per group (map-side combined)."""
    toks = scored.select((F.col(by) if by else F.lit("All")).alias("group"),
                         F.explode(words(F.col(text))).alias("term"))
    return toks.groupBy("group", "term").agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def term_frequencies(scored: DataFrame, k: int = 80, text: str = "filtered_text") -> DataFrame:
    """Top-k terms of positive, negative and all comments (count desc, term asc)."""
    # one pass over the tokens: 'All' is the sum of the classes, taken from the counted terms
    per = term_counts(scored, text, "sentiment").select(
        "term", "count", F.explode(F.array(F.col("group"), F.lit("All"))).alias("group")).where(
        F.col("group").isin("Positive", "Negative", "All"))
    both = per.groupBy("group", "term").agg(F.sum("count").cast("bigint").alias("count"))
    return top_k_per_group(both, ["group"], [F.desc("count"), F.asc("term")], k, salt=["term"])


def vocabulary(scored: DataFrame, size: int = 1000, min_df: int = 5, max_df: float = 0.8,
               text: str = "filtered_text") -> DataFrame:
    """Bag-of-words vocabulary: terms in at least ``min_df`` comments and at
    most ``max_df`` of them, the ``size`` most frequent (term asc on ties),
    with their 0-based index."""
    n_docs = scored.agg(F.count(F.lit(1))).scalar()
    # a term counts once per occurrence and once per comment (a row); both sums combine before the shuffle
    w = words(F.col(text))
    marks = F.concat(F.transform(w, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"))),
                     F.transform(F.array_distinct(w), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"))))
    stats = scored.select(F.explode(marks).alias("m")).groupBy("m.term").agg(
        F.sum("m.d").cast("bigint").alias("doc_freq"),
        F.sum(1 - F.col("m.d")).cast("bigint").alias("term_count"))
    kept = stats.where((F.col("doc_freq") >= min_df) & (F.col("doc_freq") <= F.lit(max_df) * n_docs))
    top = kept.orderBy(F.desc("term_count"), F.asc("term")).limit(size)
    from pyspark.sql import Window

    # at most ``size`` rows: a bounded window
    return top.withColumn("term_index", (F.row_number().over(
        Window.orderBy(F.desc("term_count"), F.asc("term"))) - 1).cast("bigint"))




# ---- topics (MLlib) ----------------------------------------------------------------

def lda_topics(scored: DataFrame, vocab: DataFrame, k: int = 5, passes: int = 15, seed: int = 42,
               text: str = "filtered_text", batch_share: float = 0.25):
    """N6 + N7: counts over the given vocabulary, then online variational LDA.

    Priors 1/k, learning offset 10 and decay 0.7 as in the source's topic
    model; every iteration updates from a mini-batch of ``batch_share`` of the
    comments, so ``passes`` passes take ceil(passes / batch_share) iterations.  The vocabulary (at most
    vocabSize terms) is model state and is read to the driver once.
    Returns (fitted LDA model, counted documents with all their columns, ordered vocabulary list).
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel

    terms = [r["term"] for r in vocab.orderBy("term_index").select("term").collect()]
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol="_words", outputCol="features")
    docs = cv.transform(scored.withColumn("_words", words(F.col(text))))
    lda = LDA(k=k, optimizer="online", seed=seed, maxIter=math.ceil(passes / batch_share), learningDecay=0.7, learningOffset=10.0,
              docConcentration=[1.0 / k], topicConcentration=1.0 / k, optimizeDocConcentration=False,
              subsamplingRate=batch_share, featuresCol="features")
    # every iteration passes over the counts: kept, not counted anew (the same partitions, so the same batches)
    counts = docs.select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return lda.fit(counts), docs, terms
    finally:
        counts.unpersist()


def topic_words(model, vocab: DataFrame, n: int = 10) -> DataFrame:
    """Top-n terms per topic with their (normalised) weights and the topic
    label made of the first five terms joined by ' | '."""
    t = model.describeTopics(n)
    ex = t.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "tw"))
    ex = ex.select("topic", (F.col("rank") + 1).alias("rank"), F.col("tw.termIndices").cast("bigint").alias("term_index"),
                   F.round(F.col("tw.termWeights"), 6).alias("weight"))
    j = ex.join(F.broadcast(vocab.select("term_index", "term")), "term_index")
    from pyspark.sql import Window

    lab = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term")).over(
        Window.partitionBy("topic"))), lambda s: s["term"]), 1, 5), " | ")
    return j.select("topic", "rank", "term", "weight", lab.alias("topic_label"))


def dominant_topic(model, docs: DataFrame, keep: Sequence[str] = ("order_id",)) -> DataFrame:
    """Topic with the largest share for each comment (first on ties), row by row: an order
    may hold several comments, so nothing is joined back by its id."""
    from pyspark.ml.functions import vector_to_array

    t = model.transform(docs)
    arr = vector_to_array(F.col("topicDistribution"))
    return t.select(*keep, (F.array_position(arr, F.array_max(arr)) - 1).cast("int").alias("topic"))
