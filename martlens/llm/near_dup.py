"""Operator 9: near-duplicates by b-bit MinHash.

1. Each text's five-word shingles give a set hash (equal sets form a class),
   ``ROWS x BANDS`` minima, the band keys of the full minima, and the packed
   low ``BITS`` of every minimum.
2. Classes that share a band key are candidates.  The similarity of a candidate pair is
   estimated by counting equal b-bit values (bit counts over packed planes, inside the join), corrected
   for chance agreement; pairs far below the limit and pairs whose sizes exclude it are left out.
3. What remains is confirmed on the full shingle sets.

Large groups are never paired all with all.  In star rounds every class of a
band bucket is compared with one representative of the bucket's smallest
component only, and confirmed links merge components.  At the end the pairs that lie in one
bucket but in different components are all compared, so no link between
components is missed; inside a component further links change nothing.
Every round is a few joins; nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bound_batches, cut_lineage, rows_to_batch, shingle_hashes, texts_of, unpacked
from .common import packed as packed_rows

ROWS, BANDS, BITS = 4, 32, 4
HASHES = ROWS * BANDS
_RNG = np.random.default_rng(977)
_MUL = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
#: Fine sketch of the classes that stay open after the star rounds: more hash functions, one bit of each.
FINE = 1024
_FINE_MUL = _RNG.integers(1, 1 << 63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_ADD = _RNG.integers(0, 1 << 63, FINE, dtype=np.uint64)
LIMIT = 75  # per cent
#: A pair is left out if its estimate is this many standard deviations below the limit.
SLACK = 4.0
STAR_ROUNDS = 2
#: Rows of a bucket that are paired in one block.
PAIR_BLOCK = 256


def minima(s: np.ndarray, mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    """The least value of each hash function over a set, in bounded steps."""
    out = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    step = 4096
    for i in range(0, len(s), step):
        c = s[i:i + step]
        for k in range(0, len(mul), 16):
            h = c[None, :] * mul[k:k + 16, None] + add[k:k + 16, None]
            h ^= h >> np.uint64(29)
            np.minimum(out[k:k + 16], h.min(axis=1), out=out[k:k + 16])
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    g = m.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        h = (h ^ g[:, r]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def packed(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits as bit planes of 64-bit words: the lowest bits of all minima, then the next."""
    planes = [np.packbits(((m >> np.uint64(j)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for j in range(bits)]
    return np.concatenate(planes)


def set_of(data: bytes, cache: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(data, cache))


def set_key(s: np.ndarray) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(s.tobytes())


def row_key() -> Column:
    """Names a row by its id and text, null ids too; rows that share a name and are equal are one text."""
    return F.xxhash64("doc_id", "text")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_shingles, key, bands, sig); key, bands and sig are null without words."""
    out = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.string()),
                     ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])

    def run(batches):
        cache = WordHashes()
        for b in batches:
            rows = []
            for doc_id, row, t in zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), texts_of(b)):
                s = set_of(t, cache)
                if not len(s):
                    rows.append((doc_id, row, 0, None, None, None))
                    continue
                m = minima(s)
                rows.append((doc_id, row, len(s), set_key(s), band_keys(m).tolist(), packed(m).tolist()))
            yield rows_to_batch(rows, out)

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text", row_key().alias("row_key")).mapInArrow(
        run, "doc_id long, row_key long, n_shingles long, key string, bands array<long>, sig array<long>")


def estimate(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    """Similarity by the count of equal b-bit values, corrected for chance agreement."""
    n, chance = len(a) * 64 // bits, 2.0 ** -bits
    differ = np.bitwise_or.reduce((a ^ b).reshape(bits, -1)).view(np.uint64)
    return ((n - int(np.bitwise_count(differ).sum())) / n - chance) / (1.0 - chance)


def can_reach(n_a: Column, sig_a: Column, n_b: Column, sig_b: Column, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Whether the sizes allow the limit and the estimate is not far below it; bit counts, inside the join."""
    words, chance = hashes // 64, 2.0 ** -bits
    rate = LIMIT / 100 * (1.0 - chance) + chance  # of equal values at the limit
    least = rate - SLACK * (rate * (1.0 - rate) / hashes) ** 0.5
    equal = None
    for w in range(words):
        differ = None
        for j in range(bits):
            x = sig_a[j * words + w].bitwiseXOR(sig_b[j * words + w])
            differ = x if differ is None else differ.bitwiseOR(x)
        c = 64 - F.bit_count(differ)
        equal = c if equal is None else equal + c
    return (100 * F.least(n_a, n_b) >= LIMIT * F.greatest(n_a, n_b)) & (equal >= int(np.floor(hashes * least)))


def first_shared(band: Column, bands_a: Column, bands_b: Column) -> Column:
    """Whether no earlier band is shared, so that a pair comes out of one bucket only."""
    # a higher-order function keeps the generated join code small enough to be compiled
    return ~F.exists(F.slice(F.zip_with(bands_a, bands_b, lambda x, y: x == y), F.lit(1), band), lambda x: x)


def block_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """(x, y, condition) that joins the rows of each bucket with themselves, block by block.

    A bucket of many rows is cut into ``blocks`` blocks; each pair of blocks is a join key of its own,
    so the pairs of a large bucket are spread over tasks instead of falling to one."""
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = rows.select("*", own.alias("i"), other.alias("j")).alias("x")
    y = rows.select("*", other.alias("i"), own.alias("j")).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "bucket", "i", "j")]
    return x, y, same[0] & same[1] & same[2] & same[3]


def fine_sketches(sets: DataFrame) -> DataFrame:
    """(key, fine): one bit of each of FINE minima of a full set."""
    out = pa.schema([("key", pa.string()), ("fine", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            yield rows_to_batch([(k, packed(minima(np.frombuffer(s, np.uint64), _FINE_MUL, _FINE_ADD), 1).tolist())
                                 for k, s in zip(b.column("key").to_pylist(), b.column("s").to_pylist())], out)

    return sets.mapInArrow(run, "key string, fine array<long>")


def out_ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def sets_of_classes(docs: DataFrame, reps: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, s): the full shingle set of each asked class, from the text of its representative."""
    wanted = reps.join(keys, "key").select("row_key", "key")
    texts = docs.select("text", row_key().alias("row_key")).join(wanted, "row_key")
    out = pa.schema([("key", pa.string()), ("s", pa.binary())])

    def run(batches):
        cache = WordHashes()
        for b in batches:
            rows = []
            for key, t in zip(b.column("key").to_pylist(), texts_of(b)):
                s = set_of(t, cache)
                if set_key(s) == key:  # rows of one name may be different texts
                    rows.append((key, s.tobytes()))
            yield rows_to_batch(rows, out)

    bound_batches(docs.sparkSession, rows=64)
    return texts.mapInArrow(run, out_ddl(out)).dropDuplicates(["key"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 x intersection >= LIMIT x union of the full sets."""
    j = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("s_a")), "a") \
        .join(sets.select(F.col("key").alias("b"), F.col("s").alias("s_b")), "b")
    out = pa.schema([("a", pa.string()), ("b", pa.string())])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(100 * both >= LIMIT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    bound_batches(pairs.sparkSession, rows=64)
    return j.mapInArrow(run, out_ddl(out))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node of each connected component of edges (a, b).

    Each round every node takes the least label of its neighbours and then the
    label of its label; rounds end when nothing changes.  Labels move by joins;
    a node of many neighbours is pre-aggregated before it is shuffled."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = cut_lineage(labels, "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        up = step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        jumped = step.join(up, step["label"] == up["n2"], "left").select(
            "node", "old", F.least("label", F.coalesce("l2", "label")).alias("label"))
        new = cut_lineage(jumped, "cc-labels")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_key, component_id, row_key, component_key and kept of every document.

    A-Z count in lower case; fewer than five words form one shingle; a text
    without words (or null) has no shingles and no links.  component_id is the
    smallest doc_id of the component.  Rows of one doc_id are judged each by
    their text; a null doc_id takes the smallest id of its component, and is
    kept when there is none.  An empty table gives no rows.
    """
    sig = cut_lineage(signatures(docs), "near-signatures")
    some = sig.where(F.col("key").isNotNull())
    # a class is a distinct set; it is known by its smallest doc_id, and its text is that of any of its rows
    reps = cut_lineage(some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n"),
                                               F.first("bands").alias("bands"), F.first("sig").alias("sig")), "near-classes")
    member = reps.select("key", F.posexplode("bands").alias("band", "bucket"))
    shared = member.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    member = cut_lineage(member.join(shared, ["band", "bucket"]), "near-members")
    # the class that shares most buckets with others is the likeliest original of its copies: it leads in round 0
    degree = member.groupBy("key").agg(F.sum("c").alias("degree"))
    member = cut_lineage(member.select("band", "bucket", "key").join(
        degree.join(reps.select("key", "n", "sig"), "key"), "key"), "near-ranked")
    judged = label = links = known = None  # pairs compared, components, confirmed links and sets read so far
    for step in range(STAR_ROUNDS + 1):
        m = member.withColumn("label", F.col("key")) if label is None else member.join(
            label, member["key"] == label["node"], "left").withColumn("label", F.coalesce("label", "key"))
        lead = F.struct(-F.col("degree"), F.col("key")) if step == 0 else F.struct(F.xxhash64("label", F.lit(step)), F.col("key"))
        bucket = m.groupBy("band", "bucket").agg(F.min_by(F.struct("label", "key", "n", "sig"), lead).alias("head"),
                                                 F.min("label").alias("one"), F.max("label").alias("most"),
                                                 F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
        open_ = bucket.where(F.col("one") != F.col("most")).select("band", "bucket", "head", "blocks")
        if step < STAR_ROUNDS:
            cand = m.join(open_, ["band", "bucket"]).where(
                (F.col("label") != F.col("head.label"))
                & can_reach(F.col("n"), F.col("sig"), F.col("head.n"), F.col("head.sig"))).select(
                F.col("key").alias("a"), F.col("head.key").alias("b"))
        else:
            inside = cut_lineage(m.join(open_, ["band", "bucket"]).select("band", "bucket", "blocks", "key", "label", "n", "sig"), "near-inside")
            x, y, met = block_pairs(inside)
            # only rows with a partner in their bucket that the coarse estimate allows
            inside = cut_lineage(x.join(y, met & (F.col("x.label") != F.col("y.label"))
                                        & can_reach(F.col("x.n"), F.col("x.sig"), F.col("y.n"), F.col("y.sig")), "left_semi").drop(
                "sig", "i", "j").dropDuplicates(["band", "bucket", "key"]), "near-partnered")
            keys = cut_lineage(inside.select("key").distinct(), "near-open-keys")
            fresh = cut_lineage(sets_of_classes(docs, reps.select("key", "row_key"), keys if known is None else keys.join(
                known.select("key"), "key", "left_anti")), "near-sets")
            known = fresh if known is None else known.unionByName(fresh)
            fine = fine_sketches(known.join(keys, "key")).join(reps.select("key", "bands"), "key")
            inside = cut_lineage(inside.join(fine, "key"), "near-open")
            x, y, met = block_pairs(inside)
            cand = x.join(y, met & (F.col("x.label") < F.col("y.label"))
                          & can_reach(F.col("x.n"), F.col("x.fine"), F.col("y.n"), F.col("y.fine"), FINE, 1)
                          & first_shared(F.col("x.band"), F.col("x.bands"), F.col("y.bands"))).select(
                F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        cand = cand.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if judged is not None:
            cand = cand.join(judged, ["a", "b"], "left_anti")
        pairs = cut_lineage(cand, "near-pairs")
        if pairs.isEmpty():
            continue
        judged = pairs if judged is None else judged.unionByName(pairs)
        if step < STAR_ROUNDS:
            keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
            if known is not None:
                keys = keys.join(known.select("key"), "key", "left_anti")
            sets = cut_lineage(sets_of_classes(docs, reps.select("key", "row_key"), keys), "near-sets")
            known = sets if known is None else known.unionByName(sets)
        found = cut_lineage(confirmed(pairs, known), "near-links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            label = components(links)
    out = some.select("doc_id", "row_key", "n_shingles", "key")
    least = reps.select("key", "rep")
    if label is not None:
        j = least.join(label, least["key"] == label["node"], "left").select("key", "rep", F.coalesce("label", "key").alias("label"))
        tops = j.groupBy("label").agg(F.min("rep").alias("component_id"))
        least = j.join(tops, "label").select("key", "label", "component_id")
    else:
        least = least.select("key", F.col("key").alias("label"), F.col("rep").alias("component_id"))
    names = ["doc_id", "n_shingles", "class_key", "component_id", "row_key", "component_key"]
    out = out.join(least, "key").withColumnsRenamed({"key": "class_key", "label": "component_key"}).select(*names)
    none = sig.where(F.col("key").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("string").alias("class_key"),
                                                   F.col("doc_id").alias("component_id"), "row_key", F.lit(None).cast("string").alias("component_key"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less near copies: of each component the row of the smallest doc_id stays (a row
    without an id only where no row has one; of equal ids the smallest row key).  Equal rows become one;
    texts without words link with nothing and stay."""
    found = near_duplicates(docs).where(F.col("component_key").isNotNull()).select("component_key", "doc_id", "row_key")
    found = cut_lineage(found, "near-found")
    stay = found.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("s")).select(
        F.col("s.row_key").alias("row_key"))
    gone = found.select("row_key").distinct().join(stay, "row_key", "left_anti")
    rows = packed_rows(docs).withColumn("row_key", row_key())
    return unpacked(rows.join(gone, "row_key", "left_anti").dropDuplicates(["row_key"]), docs.columns)
