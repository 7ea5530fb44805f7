"""Operator 3: language identification by Bayesian evidence fusion.

For every page the log-posterior of each language adds up
* the text likelihood (naive Bayes on hashed byte trigrams, trained on the
  labelled documents by grouped counts, tempered to ``evidence`` trigrams);
* the likelihood of the declared markup language and of the address suffix,
  both estimated over all pages by grouped counts against the text's verdict;
* the prior of the page's host, smoothed towards its domain, which is smoothed
  towards the whole; the page itself is left out of its own host's counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import bound_batches, cut_lineage, texts_of

FEATURES = 1 << 14
#: Rows of the model table in one product, and languages whose counts a task holds before it emits them.
BLOCK, HELD = 64, 256
#: Languages whose model is sent to the tasks at once.
SENT = 1024


def trigram_counts(data: bytes, into: np.ndarray) -> int:
    """Adds the hashed byte trigrams of a text (A-Z in lower case); returns their number."""
    n = 0
    low = data.lower()
    step = 1 << 20
    for i in range(0, max(len(low) - 2, 0), step):
        b = np.frombuffer(low, np.uint8, min(step + 2, len(low) - i), i).astype(np.uint32)
        if len(b) < 3:
            break
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35))
        into += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18), minlength=FEATURES)
        n += len(h)
    return n


def train_text(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages and (lang, feature, n), their grouped trigram counts, from all labelled documents; every language is kept."""
    schema = pa.schema([("lang", pa.string()), ("feature", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def emit():
            for lang, c in sums.items():
                f = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), pa.array(f.astype(np.int32)), pa.array(c[f])], schema=schema)
            sums.clear()

        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), texts_of(b)):
                if lang not in sums and len(sums) >= HELD:
                    yield from emit()
                trigram_counts(t, sums.setdefault(lang, np.zeros(FEATURES, np.int64)))
        yield from emit()

    bound_batches(docs.sparkSession)
    counts = cut_lineage(docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(
        run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")), "lang-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    return langs, counts


def text_model(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """Log-probabilities (languages x features) of some languages, 128 KB each."""
    place = {x: i for i, x in enumerate(langs)}
    table = np.full((len(langs), FEATURES), 0.5)
    some = counts.where((F.col("lang") >= langs[0]) & (F.col("lang") <= langs[-1]))  # langs are neighbours in order
    for r in some.groupBy("lang").agg(  # a row per language of at most FEATURES numbers
            F.collect_list("feature").alias("f"), F.collect_list("n").alias("n")).toLocalIterator():
        table[place[r["lang"]], r["f"]] += r["n"]
    return np.log(table / table.sum(axis=1, keepdims=True))


_OPEN = re.compile(rb"<(script|style)\b|<!--", re.I)
_CLOSE = {b"script": re.compile(rb"</script\s*>", re.I), b"style": re.compile(rb"</style\s*>", re.I), b"": re.compile(rb"-->")}
_TAG = re.compile(rb"<[^>]*>")
_ENTITY = re.compile(rb"&[#\w]{1,10};")
_HTML = re.compile(rb"<html\b[^>]*", re.I)
_LANG = re.compile(rb"\blang\s*=\s*[\"']?([a-z]{2,3})", re.I)


def plain_text(html: bytes) -> bytes:
    """A page without scripts, styles, comments, tags and entities, in time linear in its length.

    What is opened and never closed is left as it stands: no search is begun behind the last place
    where it could end."""
    last = {k: max((m.start() for m in c.finditer(html)), default=-1) for k, c in _CLOSE.items()}
    out, at, kept = [], 0, 0
    while m := _OPEN.search(html, at):
        kind = (m.group(1) or b"").lower()
        if m.end() <= last[kind]:
            at = _CLOSE[kind].search(html, m.end()).end()
            out += (html[kept:m.start()], b" ")
            kept = at
        else:
            at = m.end()
    body = b"".join((*out, html[kept:]))
    end = body.rfind(b">") + 1
    return _ENTITY.sub(b" ", _TAG.sub(b" ", body[:end])) + _ENTITY.sub(b" ", body[end:])


def declared_language(html: bytes) -> str:
    """The first language that an html tag declares, in lower case; '' without one."""
    for m in _HTML.finditer(html):
        if x := _LANG.search(m.group()):
            return x.group(1).decode().lower()
    return ""


def text_evidence(src: DataFrame, model: np.ndarray, max_evidence: int) -> DataFrame:
    """The rows of ``src`` with ll (array): log-likelihood of the text under each language of the model; n: its trigrams."""
    sent = src.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*[f for f in src.schema.fields if f.name != "html"], StructField("declared", StringType()),
                         StructField("ll", ArrayType(DoubleType())), StructField("n", LongType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        table = sent.value
        for b in batches:
            lls, declared, ns = [], [], []
            for html in texts_of(b, "html"):
                c = np.zeros(FEATURES, np.int64)
                n = trigram_counts(b" ".join(plain_text(html).split()), c)
                f = np.flatnonzero(c)
                ll = np.concatenate([table[i:i + BLOCK, f] @ c[f] for i in range(0, len(table), BLOCK)])
                lls.append((ll * (min(n, max_evidence) / max(n, 1))).tolist())
                declared.append(declared_language(html))
                ns.append(n)
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names[:-3]], pa.array(declared, pa.string()),
                                              pa.array(lls, pa.list_(pa.float64())), pa.array(ns, pa.int64())], names=names)

    bound_batches(src.sparkSession)
    return src.mapInArrow(run, schema)


def evidence(pages: DataFrame, langs: list[str], counts: DataFrame, max_evidence: int = 100) -> DataFrame:
    """page_id, host, domain, suffix, declared, ll (array), text_lang (number; null without text).

    The model is sent to the tasks in blocks of SENT languages, 128 MB at most; with more languages than that the
    pages are read once a block and their likelihoods put together by row."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html"))
    two, one = F.substring_index("host", ".", -2), F.substring_index("host", ".", -1)
    dotted = F.instr(two, ".") > 1
    src = src.select("page_id", "host", F.when(dotted & (one != ""), two).otherwise("").alias("domain"), one.alias("suffix"), "html")
    blocks = [langs[i:i + SENT] for i in range(0, len(langs), SENT)]
    if len(blocks) == 1:
        e = text_evidence(src, text_model(counts, langs), max_evidence)
    else:
        src = cut_lineage(src.withColumn("row", F.monotonically_increasing_id()), "lang-pages")
        e = None
        for some in blocks:
            part = cut_lineage(text_evidence(src if e is None else src.select("row", "html"), text_model(counts, some), max_evidence), "lang-part")
            e = part if e is None else e.join(part.select("row", F.col("ll").alias("more")), "row").withColumn(
                "ll", F.concat("ll", "more")).drop("more")
        e = e.drop("row")
    e = e.withColumn("top", F.array_max("ll"))
    return cut_lineage(e.select(
        "page_id", "host", "domain", "suffix", "declared", F.transform("ll", lambda x: x - F.col("top")).alias("ll"),
        F.when(F.col("n") > 0, F.array_position("ll", F.col("top")) - 1).cast("int").alias("text_lang")), "lang-evidence")


def identify(pages: DataFrame, docs: DataFrame, strength: float = 5.0, max_evidence: int = 100) -> DataFrame:
    """page_id, host, declared, lang, confidence, text_lang of every page.

    Null url, html or declaration is absent evidence (its own value ''); a page
    without any text is decided by the other evidence.  Repeated rows are
    counted each.  Without labelled documents lang and confidence are null; an
    empty table gives no rows.
    """
    langs, counts = train_text(docs)
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit("").alias("host"), F.lit("").alias("declared"),
                            F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"),
                            F.lit(None).cast("string").alias("text_lang"))
    e = evidence(pages, langs, counts, max_evidence)
    k = len(langs)

    def per_lang(*by):
        """One row per value of ``by`` with n, its pages per language of the text; no expression per language."""
        pairs = e.groupBy(*by, "text_lang").agg(F.count(F.lit(1)).cast("double").alias("c"))
        found = F.collect_list(F.when(F.col("text_lang").isNotNull(), F.struct("text_lang", "c")))
        return pairs.groupBy(*by).agg(F.map_from_entries(found).alias("m")).select(
            *by, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("n"))

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def smooth(counts, prior):
        return F.transform(prior, lambda p, i: (F.get(counts, i) + strength * p) / (total(counts) + strength))

    all_n = per_lang()
    whole = all_n.select(F.transform("n", lambda x: (x + 1.0) / (total(F.col("n")) + k)).alias("p"))
    domains = per_lang("domain").withColumn("_all", whole.scalar()).select(
        "domain", smooth(F.col("n"), F.col("_all")).alias("domain_prior"))
    hosts = per_lang("host", "domain").withColumnRenamed("n", "host_n").join(domains, "domain").select("host", "host_n", "domain_prior")

    def likelihood(col):
        n = per_lang(col)
        values = n.agg(F.count(F.lit(1)).alias("v"))
        return n.withColumn("_s", all_n.select("n").scalar()).withColumn("_v", values.scalar()).select(col, F.transform(
            "n", lambda x, i: F.log((x + 0.5) / (F.get("_s", i) + 0.5 * F.col("_v")))).alias(f"{col}_ll"))

    j = e.join(hosts, "host", "left").join(likelihood("declared"), "declared", "left").join(likelihood("suffix"), "suffix", "left")
    own = F.transform("host_n", lambda n, i: n - F.when(i == F.col("text_lang"), 1.0).otherwise(0.0))
    j = j.withColumn("_prior", smooth(own, F.col("domain_prior")))
    # a declaration or suffix that is absent tells nothing
    j = j.withColumn("_post", F.transform("ll", lambda x, i: x + F.log(F.get("_prior", i))
                                          + F.when(F.col("declared") != "", F.get("declared_ll", i)).otherwise(0.0)
                                          + F.when(F.col("suffix") != "", F.get("suffix_ll", i)).otherwise(0.0)))
    j = j.withColumn("_max", F.array_max("_post"))
    names = F.array(*[F.lit(x) for x in langs])
    return j.select("page_id", "host", "declared", F.element_at(names, F.array_position("_post", F.col("_max")).cast("int")).alias("lang"),
                    (1.0 / F.aggregate("_post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_max")))).alias("confidence"),
                    F.get(names, F.col("text_lang")).alias("text_lang"))
