"""Operator 11: periodic runs of words by constant-time longest common extensions on suffix trees.

Every run of smallest period p holds a Lyndon root, which is the longest Lyndon
word at its start under the order of the words or under the reversed order.
So each place gives one candidate per order: its longest Lyndon word, whose end
is the next smaller suffix.  A candidate is extended to both sides by longest
common extensions: to the right on the Ukkonen suffix tree of the text, to the
left on that of the reversed text.  An extension is the string depth of a
lowest common ancestor, found in constant time by a range minimum over the
Euler tour of the tree, whose levels differ by one (blocks of eight levels in a
table of patterns, a sparse table over block minima).

Trees are built for the stretches of a text in which every four consecutive
words occur at least twice: inside a run of four periods and six words all do,
so no run and no end of a run is lost, and plain prose needs no tree at all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, read_docs, texts_of

#: What counts as a run: this many periods and this many words at least.
PERIODS, WORDS = 4, 6
#: Within a run of that size every GRAM consecutive words stand twice or more.
GRAM = 4

_BLOCK = 8


def _patterns() -> np.ndarray:
    """[pattern of seven steps of +1 or -1][from][to] -> place of the least level."""
    steps = ((np.arange(1 << (_BLOCK - 1))[:, None] >> np.arange(_BLOCK - 1)) & 1) * 2 - 1
    level = np.concatenate((np.zeros((len(steps), 1), np.int64), steps.cumsum(axis=1)), axis=1)
    table = np.zeros((len(steps), _BLOCK, _BLOCK), np.int8)
    for a in range(_BLOCK):
        for b in range(a, _BLOCK):
            table[:, a, b] = a + level[:, a:b + 1].argmin(axis=1)
    return table


_PATTERNS = _patterns()


class SuffixTree:
    """Suffix tree of symbols (1 and up; 0 is put at the end), built by Ukkonen's algorithm in linear time."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        n, m = len(s), max(s) + 1
        start, stop, link = [0], [0], [0]
        leaf_of: list[int] = []
        child: dict[int, int] = {}  # parent * m + first symbol of the edge -> node
        node = length = edge = open_ = 0
        for i, c in enumerate(s):
            open_ += 1
            waiting = 0  # an inner node that still needs its suffix link
            while open_:
                if not length:
                    edge = i
                key = node * m + s[edge]
                nxt = child.get(key)
                if nxt is None:
                    child[key] = len(start)
                    leaf_of.append(len(start))
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    size = stop[nxt] - start[nxt]
                    if length >= size:
                        node, edge, length = nxt, edge + size, length - size
                        continue
                    at = start[nxt]
                    if s[at + length] == c:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    split = len(start)
                    start += (at, i)
                    stop += (at + length, n)
                    link += (0, 0)
                    leaf_of.append(split + 1)
                    child[key] = split
                    child[split * m + c] = split + 1
                    start[nxt] = at + length
                    child[split * m + s[at + length]] = nxt
                    if waiting:
                        link[waiting] = split
                    waiting = split
                open_ -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_ + 1
        self.n, self.nodes = n, len(start)
        self.leaf = np.array(leaf_of, np.int64)
        self._size = np.array(stop, np.int64) - np.array(start, np.int64)
        self._key = np.fromiter(child.keys(), np.int64, len(child))
        self._child = np.fromiter(child.values(), np.int64, len(child))
        self._m = m
        self._tour()

    def _children(self, falling: bool) -> tuple[list[int], list[int]]:
        """Children of every node in the order of their symbols, 0 first; (where each node's begin, all)."""
        parent, sym = np.divmod(self._key, self._m)
        order = np.lexsort((np.where(sym > 0, -sym, -self._m) if falling else sym, parent))
        begin = np.searchsorted(parent[order], np.arange(self.nodes + 1))
        return begin.tolist(), self._child[order].tolist()

    def _tour(self) -> None:
        """Euler tour: the nodes as met, and the first meeting of each."""
        begin, kids = self._children(False)
        at, size = begin[:-1], self._size.tolist()
        depth, first = [0] * self.nodes, [0] * self.nodes
        tour, level, path = [0], [0], [0]
        while path:
            v = path[-1]
            k = at[v]
            if k < begin[v + 1]:
                at[v] = k + 1
                w = kids[k]
                depth[w] = depth[v] + size[w]
                first[w] = len(tour)
                path.append(w)
            else:
                path.pop()
                if not path:
                    break
                w = path[-1]
            tour.append(w)
            level.append(len(path) - 1)
        self.depth, self._first = np.array(depth, np.int64), np.array(first, np.int64)
        pad = -len(tour) % _BLOCK
        top = level[-1]
        level += [top + 1 + k for k in range(pad)]  # levels go on rising by one
        self._node = np.array(tour + [0] * pad, np.int64)
        self._level = np.array(level, np.int32)
        rows = self._level.reshape(-1, _BLOCK)
        self._pattern = ((np.diff(rows, axis=1) > 0) << np.arange(_BLOCK - 1)).sum(axis=1)
        least = rows.argmin(axis=1) + np.arange(0, len(self._level), _BLOCK)
        self._sparse = [least]
        half = 1
        while 2 * half <= len(least):
            a, b = self._sparse[-1][:-half], self._sparse[-1][half:]
            self._sparse.append(np.where(self._level[a] <= self._level[b], a, b))
            half *= 2

    def _lowest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the least level in each stretch a..b of the tour (a <= b)."""
        ka, kb = a // _BLOCK, b // _BLOCK
        same = ka == kb
        left = ka * _BLOCK + _PATTERNS[self._pattern[ka], a % _BLOCK, np.where(same, b % _BLOCK, _BLOCK - 1)]
        right = kb * _BLOCK + _PATTERNS[self._pattern[kb], np.where(same, a % _BLOCK, 0), b % _BLOCK]
        best = np.where(self._level[left] <= self._level[right], left, right)
        inner = np.flatnonzero(kb - ka > 1)
        lo, hi = ka[inner] + 1, kb[inner] - 1
        step = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        for j in np.unique(step):
            at = np.flatnonzero(step == j)
            x, y = self._sparse[j][lo[at]], self._sparse[j][hi[at] - (1 << int(j)) + 1]
            z = np.where(self._level[x] <= self._level[y], x, y)
            o = inner[at]
            best[o] = np.where(self._level[z] < self._level[best[o]], z, best[o])
        return best

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j (i != j)."""
        a, b = self._first[self.leaf[i]], self._first[self.leaf[j]]
        return self.depth[self._node[self._lowest(np.minimum(a, b), np.maximum(a, b))]]

    def ranks(self, falling: bool) -> np.ndarray:
        """Rank of every suffix under the order of the symbols or the falling order; 0, the end, is least in both."""
        begin, kids = self._children(falling)
        suffix = np.full(self.nodes, -1, np.int64)
        suffix[self.leaf] = np.arange(self.n)
        suffix = suffix.tolist()
        seen, path = [], [0]
        while path:
            v = path.pop()
            if suffix[v] >= 0:
                seen.append(suffix[v])
            else:
                path += kids[begin[v]:begin[v + 1]][::-1]
        out = np.empty(self.n, np.int64)
        out[seen] = np.arange(self.n)
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """Next place of a smaller rank for every place but the last, whose rank is the least."""
    r = rank.tolist()
    out = [0] * (len(r) - 1)
    path = [len(r) - 1]
    for i in range(len(r) - 2, -1, -1):
        while r[path[-1]] > r[i]:
            path.pop()
        out[i] = path[-1]
        path.append(i)
    return np.array(out, np.int64)


def runs_of_symbols(symbols: list[int], periods: int = 2, least: int = 2) -> np.ndarray:
    """All runs (start, length, period) of symbols >= 1, sorted: ``periods`` (2 or more) times their smallest period."""
    n = len(symbols)
    if n < max(least, periods):
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found = []
    for falling in (False, True):
        i = np.arange(n)
        j = next_smaller(ahead.ranks(falling))
        p = j - i
        # suffix n is the end alone: it shares nothing with any other
        right = ahead.lce(i, j)
        left = np.where(i > 0, back.lce(n - i, n - j), 0)
        size = left + p + right
        keep = (size >= periods * p) & (size >= least)
        found.append(np.stack((i - left, size, p), axis=1)[keep])
    return np.unique(np.concatenate(found), axis=0)


def repeated_stretches(ids: np.ndarray, gram: int = GRAM) -> list[tuple[int, int]]:
    """Stretches (start, stop) of ids in which every ``gram`` (a power of two) consecutive ids occur at least twice."""
    key, width = ids, 1
    count = None
    while width < gram:
        if len(key) <= width:
            return []
        pair = key[:-width] * np.int64(len(ids) + 1) + key[width:]
        _, key, count = np.unique(pair, return_inverse=True, return_counts=True)
        width *= 2
    twice = np.concatenate(([0], (count[key] > 1).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(twice))
    return [(int(a), int(b) + gram - 1) for a, b in zip(edge[::2], edge[1::2])]


def find_runs(words: list[bytes]) -> np.ndarray:
    """Runs (start, length, period) of words, of PERIODS smallest periods and WORDS words at least, by start and period."""
    if len(words) < WORDS:
        return np.zeros((0, 3), np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    out = []
    for a, b in repeated_stretches(ids):
        if b - a >= WORDS:
            _, small = np.unique(ids[a:b], return_inverse=True)
            out.append(runs_of_symbols((small + 1).tolist(), PERIODS, WORDS) + (a, 0, 0))
    runs = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def after_first_period(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in a run after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return edge.cumsum()[:n] > 0


RUNS = "array<struct<start:long,length:long,period:long>>"


def collapse_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and collapsed, the text without the repeats of its runs.

    Words are separated by spaces and the bytes 09 to 0D; ``prepare`` may change a document's words
    first.  ``collapsed`` joins the kept words by one space.  Null, empty and blank texts have no
    words, no runs and an empty ``collapsed``; rows are judged one by one, so repeated rows, null ids
    and other columns need no care; an empty table gives no rows.  A text is never split over tasks:
    memory grows with the longest stretch of repeated words of one text (about 1 KB a word)."""
    run_t = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_t)), ("collapsed", pa.string())])

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            sizes, ends, found, texts = [], [0], [], []
            for doc_id, t in zip(ids, texts_of(b)):
                words = t.split()
                if prepare is not None:
                    words = prepare(doc_id, words)
                runs = find_runs(words)
                if len(runs):
                    drop = after_first_period(len(words), runs)
                    kept = [w for w, d in zip(words, drop.tolist()) if not d]
                else:
                    kept = words
                sizes.append(len(words))
                found.append(runs)
                ends.append(ends[-1] + len(runs))
                texts.append(b" ".join(kept))
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                 pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

    bound_batches(docs.sparkSession)
    return read_docs(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text").mapInArrow(
        run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by crc32 of its decimal doc_id, its words from a place on made periodic; null ids never."""
    import zlib

    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a:a + p]
    return words[:a] + (root * ((n - a) // len(root) + 1))[:n - a]


def run_report(docs: DataFrame) -> DataFrame:
    """Per document with every tenth made periodic: the number of runs, the longest one and digests; see collapse_runs()."""
    r = collapse_runs(docs, planted)
    best = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("l"), x["start"].alias("s"), x["period"].alias("p"))))
    listed = F.concat_ws("", F.transform("runs", lambda x: F.concat_ws(
        "", x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))))
    r = r.withColumn("best", best)
    return r.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.expr("-best.l * 1000 div best.p").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
