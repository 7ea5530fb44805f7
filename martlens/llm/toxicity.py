"""Operator 8: counterfactual-regularised toxicity classifier.

A logistic regression on the presence of words and word beginnings.  For labelled texts that name a group
of people, the group terms are swapped for other terms of their kind, and the
loss adds ``penalty`` times the squared change of the score.  So a mere mention
of a group cannot carry weight that another group's mention does not.

Training takes at most ``max_rows`` labelled documents (the smallest by a hash
of the id); the vocabulary comes from a grouped count over their words.  The
fit sees only vocabulary numbers of those rows.  All documents are scored.
A swap exchanges inflected forms too, and all features are taken anew from the
swapped words, so a group term's beginnings carry no weight of their own either.
Group terms are known in English, German, French and Spanish.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, rows_to_batch, segments, texts_of

MAX_ROWS, VOCABULARY = 20_000, 4000
#: Group terms by kind, each with its inflected forms in one order for the whole kind; a form is swapped
#: only for the same form of another term of its kind (a term of fewer forms gives its last).
IDENTITY = (
    ("woman women", "man men", "girl girls", "boy boys", "female females", "male males", "transgender transgenders", "nonbinary nonbinaries"),
    ("muslim muslims", "christian christians", "jewish jews jew", "hindu hindus", "buddhist buddhists", "sikh sikhs", "atheist atheists",
     "catholic catholics", "protestant protestants"),
    ("black blacks", "white whites", "asian asians", "african africans", "european europeans", "latino latinos latina latinas",
     "hispanic hispanics", "arab arabs", "indian indians", "chinese", "mexican mexicans"),
    ("gay gays", "lesbian lesbians", "straight straights", "bisexual bisexuals", "queer queers", "heterosexual heterosexuals",
     "homosexual homosexuals"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old older oldest", "young younger youngest", "elderly", "teenage teenager teenagers"),
    ("immigrant immigrants", "refugee refugees", "foreigner foreigners", "migrant migrants"),
    # German
    ("frau frauen", "mann männer", "mädchen", "junge jungen"),
    ("muslimisch muslimische muslimischen muslimischer", "christlich christliche christlichen christlicher",
     "jüdisch jüdische jüdischen jüdischer", "katholisch katholische katholischen katholischer"),
    ("moslem moslems", "muslime muslimen", "christen", "juden", "hindus", "buddhisten", "katholiken", "protestanten"),
    ("schwarz schwarze schwarzen schwarzer", "weiß weiße weißen weißer", "arabisch arabische arabischen arabischer",
     "afrikanisch afrikanische afrikanischen afrikanischer", "asiatisch asiatische asiatischen asiatischer"),
    ("schwul schwule schwulen schwuler", "lesbisch lesbische lesbischen lesbischer"),
    ("einwanderer einwanderern", "flüchtling flüchtlinge flüchtlingen", "ausländer ausländern", "migranten"),
    # French
    ("femme femmes", "homme hommes", "fille filles", "garçon garçons"),
    ("musulman musulmans musulmane musulmanes", "chrétien chrétiens chrétienne chrétiennes", "juif juifs juive juives",
     "catholique catholiques", "bouddhiste bouddhistes"),
    ("noir noirs noire noires", "blanc blancs blanche blanches", "arabe arabes", "africain africains africaine africaines",
     "asiatique asiatiques"),
    ("lesbienne lesbiennes", "homosexuel homosexuels", "hétérosexuel hétérosexuels"),
    ("immigré immigrés immigrée immigrées", "réfugié réfugiés réfugiée réfugiées", "étranger étrangers étrangère étrangères"),
    # Spanish
    ("mujer mujeres", "hombre hombres", "chica chicas", "chico chicos"),
    ("musulmán musulmanes musulmana musulmanas", "cristiano cristianos cristiana cristianas", "judío judíos judía judías",
     "católico católicos católica católicas"),
    ("negro negros negra negras", "blanco blancos blanca blancas", "árabe árabes", "africano africanos africana africanas",
     "asiático asiáticos asiática asiáticas"),
    ("lesbiana lesbianas", "heterosexuales", "homosexuales"),
    ("inmigrante inmigrantes", "refugiado refugiados refugiada refugiadas", "extranjero extranjeros extranjera extranjeras"),
)
_FORMS = [[t.encode().split() for t in terms] for terms in IDENTITY]
#: form -> (kind, term, place among the forms); a word of several kinds counts for the first.
_KIND: dict[bytes, tuple[int, int, int]] = {}
for _k, _terms in enumerate(_FORMS):
    for _t, _forms in enumerate(_terms):
        for _i, _w in enumerate(_forms):
            _KIND.setdefault(_w, (_k, _t, _i))
# A-Z in lower case, ASCII signs and control characters as spaces
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


#: Besides words, their beginnings of these lengths (bytes) are features, so unseen forms of a stem count.
STEMS = (4, 5)


def features_of(words: set[bytes]) -> set[bytes]:
    """The words, and the beginnings of longer ones, marked by ^."""
    return words | {b"^" + w[:n] for w in words for n in STEMS if len(w) > n}


def features_in(data: bytes) -> set[bytes]:
    """Distinct folded words of a whole text, and the beginnings of longer ones, marked by ^."""
    return features_of(words_in(data))


def words_in(data: bytes) -> set[bytes]:
    """Distinct folded words of a whole text."""
    out: set[bytes] = set()
    for seg in segments(data):
        out.update(seg.translate(_FOLD).split())
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, toxic, words): at most ``max_rows`` labelled documents that are not held out.

    One row per doc_id: of several texts the smallest counts, so repeated rows cannot pass the bound."""
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = (docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    out = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.binary()))])

    def run(batches):
        for b in batches:
            yield rows_to_batch([(i, y, sorted(features_in(t))) for i, y, t in zip(
                b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), texts_of(b))], out)

    bound_batches(docs.sparkSession)
    return cut_lineage(rows.mapInArrow(run, "doc_id long, toxic int, words array<binary>"), "toxic-train")


def vocabulary(train: DataFrame, size: int = VOCABULARY) -> dict[bytes, float]:
    """feature -> scale of the ``size`` features whose presence tells most (five or more documents;
    standardised excess of toxic ones) and of all features of the group terms.

    The scale is the log ratio of the feature's smoothed rates in both classes: a feature that
    tells little alone gets little weight for the same penalty."""
    n = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    total, toxic = int(n[0]), int(n[1])
    if not toxic or toxic == total:
        return {}
    c = train.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= 5)
    p = F.lit(toxic / total)
    z = (F.col("t") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p) + 1.0)
    scale = F.abs(F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (total - toxic + 1.0)))
    top = c.select("w", F.abs(z).alias("z"), scale.alias("s")).orderBy(F.desc("z"), "w").limit(size).collect()
    return dict.fromkeys(features_of(set(_KIND)), 0.5) | {bytes(r["w"]): max(float(r["s"]), 0.05) for r in top}


def _csr(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(r) for r in rows], dtype=np.int64)
    return np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), lens)


def fit(rows: list[list[int]], swapped: list[tuple[list[int], list[int]]], y: np.ndarray, scale: np.ndarray,
        penalty: float = 1.0, ridge: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Weights (bias last) of the penalised logistic regression, by full-batch Adam on weights over scale.

    ``swapped``: for texts with group terms, (numbers lost, numbers gained) by the swap."""
    cols, at = _csr(rows)
    lost, lost_at = _csr([a for a, _ in swapped])
    got, got_at = _csr([b for _, b in swapped])
    n, m, size = len(rows), max(len(swapped), 1), len(scale)
    scale = np.append(scale, 1.0)
    w, g1, g2 = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[size] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for k in range(1, steps + 1):
        u = w * scale
        s = np.bincount(at, u[cols], n) + u[size]
        d = 1.0 / (1.0 + np.exp(-np.clip(s, -40, 40))) - y
        grad = np.bincount(cols, d[at], size + 1) / n
        grad[size] = d.mean()
        if swapped:
            change = np.bincount(got_at, u[got], len(swapped)) - np.bincount(lost_at, u[lost], len(swapped))
            grad += 2 * penalty / m * (np.bincount(got, change[got_at], size + 1) - np.bincount(lost, change[lost_at], size + 1))
        grad *= scale
        grad[:size] += 2 * ridge * w[:size]
        g1 = 0.9 * g1 + 0.1 * grad
        g2 = 0.999 * g2 + 0.001 * grad * grad
        w -= 0.1 * (g1 / (1 - 0.9 ** k)) / (np.sqrt(g2 / (1 - 0.999 ** k)) + 1e-9)
    return w * scale


def counterfactual(words: set[bytes], doc_id: int) -> set[bytes]:
    """The same words with each form of a group term swapped for that form of another term of its kind;
    all forms of one term for one and the same other term."""
    terms = words & _KIND.keys()
    gained = set()
    for w in terms:
        kind, term, place = _KIND[w]
        others = [f for i, f in enumerate(_FORMS[kind]) if i != term]
        forms = others[zlib.crc32(_FORMS[kind][term][0] + str(doc_id).encode()) % len(others)]
        gained.add(forms[min(place, len(forms) - 1)])
    return (words - terms) | gained


def train_model(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, size: int = VOCABULARY,
                penalty: float = 1.0) -> dict:
    """Vocabulary and weights; with no labelled rows of both classes a constant model."""
    train = training_rows(docs, labels, max_rows)
    vocab = vocabulary(train, size)
    if not vocab:
        rate = train.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        return {"number": {}, "weights": np.array([20.0 if rate > 0.5 else -20.0])}
    order = sorted(vocab)
    number = {w: i for i, w in enumerate(order)}
    table = _in_vocabulary(train, number)
    rows, swapped, y = [], [], []
    for r in table.toLocalIterator():  # at most max_rows rows of vocabulary numbers
        rows.append(r["words"])
        y.append(r["toxic"])
        if r["lost"] is not None:
            swapped.append((r["lost"], r["gained"]))
    return {"number": number, "weights": fit(rows, swapped, np.array(y, float), np.array([vocab[w] for w in order]), penalty)}


def _in_vocabulary(train: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """The vocabulary numbers of each row; lost and gained are those that its counterfactual changes,
    word beginnings included (null without a group term)."""
    known = train.sparkSession.sparkContext.broadcast(number)
    out = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), *[(c, pa.list_(pa.int32())) for c in ("words", "lost", "gained")]])

    def run(batches):
        def numbers(features):
            return sorted(known.value[w] for w in features if w in known.value)

        for b in batches:
            rows = []
            for i, y, ws in zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), b.column("words").to_pylist()):
                mine, lost, gained = set(ws), None, None
                words = {w for w in mine if w[:1] != b"^"}
                if words & _KIND.keys():
                    other = features_of(counterfactual(words, i))
                    lost, gained = numbers(mine - other), numbers(other - mine)
                rows.append((i, y, numbers(mine), lost, gained))
            yield rows_to_batch(rows, out)

    return train.mapInArrow(run, "doc_id long, toxic int, words array<int>, lost array<int>, gained array<int>")


def score(docs: DataFrame, model: dict, carry: list[str]) -> DataFrame:
    """The carried columns and score: the probability of label 1 given the whole text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(
        ({w: float(model["weights"][i]) for w, i in model["number"].items()}, float(model["weights"][-1])))

    def run(batches):
        weights, bias = sent.value
        for b in batches:
            s = np.array([bias + sum(sorted(weights[w] for w in features_in(t) & weights.keys())) for t in texts_of(b)], dtype=float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(s, -40, 40))))],
                                             names=[*b.schema.names, "_score"])

    src = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, "text"])])
    bound_batches(docs.sparkSession)
    from pyspark.sql.types import DoubleType, StructField, StructType

    return src.mapInArrow(run, StructType([*src.schema.fields, StructField("_score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, penalty: float = 1.0) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null or empty text scores by the bias alone.  Null labels are skipped; of
    several labels of one document the largest counts.  Repeated rows score
    alike; a null doc_id counts as held out; an empty table gives no rows.
    """
    model = train_model(docs, labels, max_rows, penalty=penalty)
    s = score(docs, model, ["doc_id"])
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
                    (F.col("_score") >= 0.5).cast("int").alias("predicted"))
