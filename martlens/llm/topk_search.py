"""Operator 13: exact top-k by inner product, branch and bound over ball trees.

1. Rows are dealt to cells by the top of a ball tree, fitted on a bounded sample;
   every row goes down that tree.  A cell of many rows is salted into shards of
   bounded size, so copies of one vector never fill one task.
2. Each shard gets its own ball tree (centre and radius of every node), written
   as one row.  No row is left out of a tree.
3. A query first searches one shard of the cell with the highest upper bound
   of the inner product (query . centre + |query| x radius), and gets a k-th
   score.  That score is shared: in the next waves only cells whose bound reaches
   it are visited, best first, and a tree is left as soon as no node's bound
   reaches the k-th score known so far, its own or the shared one.

Bounds are floating-point with a margin for rounding; scores are exact
integers.  Queries meet shards in blocks.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut_lineage, rows_to_batch

#: Rows of a tree's leaf, of a shard's tree, and queries of a block.
LEAF, SHARD, BLOCK = 64, 8192, 512
#: The sample that places the cells, and how many of its rows a cell needs; so there are at most SAMPLE / PER_CELL cells.
SAMPLE, PER_CELL = 16_384, 64
#: After the first shard: up to which cell, by falling bound, a query goes before the k-th score is shared again; at last all.
WAVES = (4, None)
#: Blocks that share one copy of a shard's tree.
SHARED_BLOCKS = 64
_EXACT = float(1 << 53)


def quantised(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v, copies): floor(256 x) of every component; equal rows once, with their number.

    Rows without id, without vector, or with a null or non-finite component are left out."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda a: a.cast("double"))
    bad = F.exists("x", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad).select(
        "id", F.transform("x", lambda a: F.floor(a * 256.0).cast("long")).alias("v")).groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))


def aligned(vectors: Sequence[Sequence[int]], width: int = 0) -> np.ndarray:
    """Vectors as rows of one matrix; shorter ones end in zeros, which add nothing to a product."""
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def halves(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(direction, places in two halves, border) between two far points; equal points are halved by place."""
    a = x[((x - centre) ** 2).sum(axis=1).argmax()]
    b = x[((x - a) ** 2).sum(axis=1).argmax()]
    along = x @ (b - a)
    order = np.argsort(along, kind="stable")
    return b - a, order, float(along[order[len(order) // 2]])


class Cells:
    """The top of the tree: cuts fitted on a bounded sample, leaves numbered as cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cuts: list[tuple] = []  # (direction, border, left, right); a child below 0 is cell -1 - child
        self.centres: list[np.ndarray] = []
        self.root = self._grow(sample.astype(np.float64), cells)

    def _grow(self, x: np.ndarray, cells: int) -> int:
        centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        if cells < 2 or len(x) < 2:
            self.centres.append(centre)
            return -len(self.centres)
        direction, order, border = halves(x, centre)
        low = (x @ direction) < border
        if not low.any():  # all on one point: a cell of its own, salted later
            self.centres.append(centre)
            return -len(self.centres)
        at = len(self.cuts)
        self.cuts.append(())
        self.cuts[at] = (direction, border, self._grow(x[low], cells // 2), self._grow(x[~low], cells - cells // 2))
        return at

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of every row."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                direction, border, left, right = self.cuts[node]
                low = (x[rows][:, :len(direction)] @ direction[:x.shape[1]]) < border
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


def distance(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distance of every row from a centre, with zeros where one is wider."""
    w = min(x.shape[1], len(centre))
    d = np.sqrt(((x[:, :w] - centre[:w]) ** 2).sum(axis=1) + (x[:, w:] ** 2).sum(axis=1) + (centre[w:] ** 2).sum())
    return d * (1 + 1e-9) + 1e-6


def build_tree(ids: np.ndarray, copy: np.ndarray, m: np.ndarray) -> bytes:
    """The ball tree of a shard as bytes: rows in leaf order and, per node, centre, radius, stretch of rows and children."""
    x = m.astype(np.float64)
    order = np.arange(len(x))
    centre, radius, first, last, left, right = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        k = len(centre)
        some = x[order[a:b]]
        c = some.mean(axis=0)
        centre.append(c)
        radius.append(float(distance(some, c).max()))
        first.append(a)
        last.append(b)
        left.append(-1)
        right.append(-1)
        if b - a > LEAF:
            _, o, _ = halves(some, c)
            order[a:b] = order[a:b][o]
            mid = (a + b) // 2
            left[k], right[k] = node(a, mid), node(mid, b)
        return k

    node(0, len(x))
    out = io.BytesIO()
    np.savez(out, ids=ids[order], copy=copy[order], m=m[order], centre=np.array(centre), radius=np.array(radius),
             first=np.array(first), last=np.array(last), left=np.array(left), right=np.array(right))
    return out.getvalue()


def search_tree(t: dict[str, np.ndarray], q: np.ndarray, own: int | None, k: int, kth: int | None) -> list[tuple[int, int]]:
    """The k best (score, id) of a tree for one query, best first, ties to smaller ids; none below ``kth``.

    ``own`` is the id of the query's own row: the first copy of that id with the query's vector is left out."""
    m, width = t["m"], min(t["m"].shape[1], len(q))
    qf = np.zeros(m.shape[1])
    qf[:width] = q[:width]
    qn = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
    exact = qn * t["longest"] < _EXACT  # every partial sum is below, so floating-point products are exact
    bound = t["centre"] @ qf
    bound = bound + qn * t["radius"] + 1e-9 * qn * (t["longest"] + t["radius"]) + 1e-3
    best: list[tuple[int, int]] = []  # a heap of (score, -id): the least first
    todo = [(-float(bound[0]), 0)]
    while todo:
        top, v = heapq.heappop(todo)
        if kth is not None and -top < kth:
            break  # nodes come by falling bound, so none of the rest reaches the k-th score
        if t["left"][v] >= 0:
            for w in (int(t["left"][v]), int(t["right"][v])):
                if kth is None or bound[w] >= kth:
                    heapq.heappush(todo, (-float(bound[w]), w))
            continue
        a, b = int(t["first"][v]), int(t["last"][v])
        if exact:
            s = (t["mf"][a:b] @ qf).astype(np.int64)
        else:  # Python integers; what exceeds 64 bits stays at the limit
            wide = [min(max(sum(x * y for x, y in zip(r, q.tolist())), -(1 << 63)), (1 << 63) - 1) for r in m[a:b].tolist()]
            s = np.array(wide, np.int64)
        pick = np.arange(b - a) if kth is None else np.flatnonzero(s >= kth)
        if not len(pick):
            continue
        ids = t["ids"][a:b]
        if own is not None:
            mine = pick[(ids[pick] == own) & (t["copy"][a:b][pick] == 0)]
            for i in mine.tolist():
                if len(q) >= t["m"].shape[1] and np.array_equal(m[a + i], q[:m.shape[1]]) and not q[m.shape[1]:].any() \
                        or len(q) < m.shape[1] and np.array_equal(m[a + i, :len(q)], q) and not m[a + i, len(q):].any():
                    pick = pick[pick != i]
        if len(pick) > k:
            pick = pick[np.lexsort((ids[pick], -s[pick]))[:k]]
        for i in pick.tolist():
            item = (int(s[i]), -int(ids[i]))
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
        if len(best) == k and (kth is None or best[0][0] > kth):
            kth = best[0][0]
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def load_tree(data: bytes) -> dict[str, np.ndarray]:
    t = dict(np.load(io.BytesIO(data), allow_pickle=False))
    t["mf"] = t["m"].astype(np.float64)
    t["longest"] = float(np.sqrt((t["mf"] ** 2).sum(axis=1)).max())
    return t


def index_rows(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, Cells, int]:
    """(trees, cells, top, width): (cell, salt, tree) of every shard, (cell, shards, radius) of every cell, the fitted
    top and the width of the widest vector.  ``rows`` as quantised() gives them; of equal rows k + 1 are enough."""
    spark = rows.sparkSession
    one = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.least(F.col("copies"), F.lit(k + 1)).cast("int") - 1)).alias("copy"))
    facts = one.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    n, width = facts["n"], max(facts["w"] or 0, 1)
    # a bounded sample, the same on every run: the SAMPLE rows of the smallest hash
    sample = [r["v"] for r in one.where("copy = 0").orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toLocalIterator()]
    # as many cells as shards fill, and each with enough of the sample to be placed well
    top = Cells(aligned(sample, width), max(1, min(-(-n // SHARD), len(sample) // PER_CELL)))
    sent = spark.sparkContext.broadcast(top)
    dealt_t = pa.schema([("id", pa.int64()), ("copy", pa.int32()), ("v", pa.list_(pa.int64())), ("cell", pa.int32()), ("away", pa.float64())])

    def deal(batches):
        cells = sent.value
        for b in batches:
            m = aligned(b.column("v").to_pylist(), width).astype(np.float64)
            cell = cells.place(m)
            away = np.zeros(len(m))
            for c in np.unique(cell):
                away[cell == c] = distance(m[cell == c], cells.centres[c])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("copy"), b.column("v").cast(pa.list_(pa.int64())),
                                              pa.array(cell.astype(np.int32)), pa.array(away)], schema=dealt_t)

    bound_batches(spark, rows=2048)
    dealt = cut_lineage(one.select("id", "copy", "v").mapInArrow(deal, "id long, copy int, v array<long>, cell int, away double"), "ball-dealt")
    cells = cut_lineage(dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"),
                                                  F.max("away").alias("radius")), "ball-cells")
    # at most SAMPLE / PER_CELL cells, so the table is bounded
    shard = dealt.join(F.broadcast(cells.select("cell", "shards")), "cell").withColumn(
        "salt", F.pmod(F.xxhash64("id", "copy", "v"), F.col("shards")).cast("int"))

    def grow(table: pa.Table) -> pa.Table:
        m = aligned(table.column("v").to_pylist(), width)
        data = build_tree(table.column("id").to_numpy(), table.column("copy").to_numpy(), m)
        return pa.table({"cell": table.column("cell")[:1], "salt": table.column("salt")[:1], "tree": pa.array([data], pa.binary())})

    trees = shard.select("cell", "salt", "id", "copy", "v").groupBy("cell", "salt").applyInArrow(grow, "cell int, salt int, tree binary")
    return cut_lineage(trees, "ball-trees"), cells, top, width


def route(queries: DataFrame, cells: DataFrame, top: Cells, width: int) -> DataFrame:
    """(qk, id, v, block, cell, rank, bound): every query with every cell, cells by falling upper bound from rank 0.

    Cells are at most SAMPLE / PER_CELL, whatever the corpus."""
    held = sorted((r["cell"], r["shards"], r["radius"]) for r in cells.toLocalIterator())
    sent = queries.sparkSession.sparkContext.broadcast((
        np.array([c for c, _, _ in held]), np.array([r for _, _, r in held]), np.array([top.centres[c] for c, _, _ in held]).reshape(len(held), width)))
    out = pa.schema([("qk", pa.string()), ("cells", pa.list_(pa.int32())), ("bounds", pa.list_(pa.float64()))])

    def run(batches):
        cell, radius, centre = sent.value
        for b in batches:
            q = aligned(b.column("v").to_pylist(), width).astype(np.float64)
            norm = np.sqrt((q ** 2).sum(axis=1))[:, None]
            bound = q[:, :width] @ centre.T + norm * radius + 1e-9 * norm * (radius + np.sqrt((centre ** 2).sum(axis=1))) + 1e-3
            order = np.argsort(-bound, axis=1, kind="stable")
            yield pa.RecordBatch.from_arrays([b.column("qk"), pa.array(cell[order].tolist(), pa.list_(pa.int32())),
                                              pa.array(np.take_along_axis(bound, order, 1).tolist(), pa.list_(pa.float64()))], schema=out)

    bound_batches(queries.sparkSession, rows=512)
    return queries.select("qk", "v").mapInArrow(run, "qk string, cells array<int>, bounds array<double>")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, own: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k rows of ``rows`` with the greatest inner product.

    Both are (vec_id, embedding).  Ties go to the smaller vec_id; with fewer rows than k, all are given.  With ``own``
    a query's own row (same id and vector) is left out once.  Rows without id or vector, or with a null or non-finite component,
    take no part; a shorter vector counts as ending in zeros; equal rows are rows of their own, as queries and as
    results; scores beyond 64 bits stay at that limit; empty tables give no rows; other columns need no care."""
    spark = rows.sparkSession
    base = cut_lineage(quantised(rows), "ball-rows")
    mark = F.concat_ws(":", F.col("id").cast("string"), F.md5(F.concat_ws(",", F.transform("v", lambda a: a.cast("string"))).cast("binary")))
    asked = cut_lineage(quantised(queries).withColumn("qk", mark), "ball-queries")
    trees, cells, top, width = index_rows(base, k)
    n_blocks = max(1, -(-asked.count() // BLOCK))
    shares = -(-n_blocks // SHARED_BLOCKS)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qk"), F.lit(n_blocks)).cast("int"))
    routed = cut_lineage(route(asked, cells, top, width), "ball-routes")
    every = trees.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    hit_t = pa.schema([("qk", pa.string()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for b in batches:
            rows_out = []
            for data, block in zip(b.column("tree").to_pylist(), b.column("asked").to_pylist()):
                t = load_tree(data)
                for q in block:
                    rows_out += [(q["qk"], i, s) for s, i in search_tree(
                        t, np.array(q["v"], np.int64), q["id"] if own else None, k, q["kth"])]
            yield rows_to_batch(rows_out, hit_t)

    best = None
    by_score = Window.partitionBy("qk").orderBy(F.col("score").desc(), "id")
    first = (F.col("rank") == 0) & (F.col("salt") == F.pmod(F.xxhash64("qk"), F.col("shards")))
    done = 0  # cells that have been visited whole
    for wave in (0, *WAVES):
        until = F.greatest(F.size("cells") if wave is None else F.lit(max(wave, 1)), F.lit(done))
        some = routed.select("qk", F.posexplode(F.slice(F.arrays_zip("cells", "bounds"), F.lit(done + 1), until - done)).alias("rank", "c"))
        if best is None:
            some = some.withColumn("kth", F.lit(None).cast("long"))
        else:
            some = some.join(best.where(F.col("r") == k).select("qk", F.col("score").alias("kth")), "qk", "left")
        some = some.where(F.col("kth").isNull() | (F.col("c.bounds") >= F.col("kth"))).select(
            "qk", "kth", F.col("c.cells").alias("cell"), (F.col("rank") + done).alias("rank"))
        visits = asked.select("qk", "id", "v", "block").join(some, "qk").join(F.broadcast(cells.select("cell", "shards")), "cell")
        visits = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where(first if wave == 0 else ~first)
        blocks = visits.groupBy("cell", "salt", "block").agg(F.collect_list(F.struct("qk", "id", "v", "kth")).alias("asked")).withColumn(
            "share", (F.col("block") / SHARED_BLOCKS).cast("int"))
        bound_batches(spark, rows=4)
        met = every.join(blocks, ["cell", "salt", "share"]).select("tree", "asked")
        found = met.mapInArrow(run, "qk string, id long, score long")
        found = found if best is None else found.unionByName(best.select("qk", "id", "score"))
        best = cut_lineage(found.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k), "ball-best")
        done = wave or 0
    return asked.select("qk", F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).join(best, "qk").select(
        "query_id", F.col("r").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")

