"""Distributed building blocks: global prefix sums / row numbers, exact
quantiles, histograms, box statistics, top-k per group, samples.

None of them pulls a whole table or an unbounded group into one task:

* a global order is cut into range partitions; each partition is summed
  locally (Arrow batches, running sum carried across batches), per-partition
  totals (one row per partition) are prefix-summed and broadcast back; the
  same path runs at every size;
* quantiles are selected by refining histograms of an order-preserving key, for
  all groups and probabilities at once, without a sort or a copy of the rows;
* top-k per group ranks inside salted sub-groups first, then ranks the
  (k x buckets) survivors per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.columns import md5_key
from ..session import cut_lineage

#: Group tables (one row per group) up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_GROUPS = 10_000


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery (computed once, no join)."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row")).scalar()


def with_row(df: DataFrame, row_df: DataFrame) -> DataFrame:
    """Adds every column of a one-row frame to ``df`` as scalar values.

    The struct is projected once and its fields read from that column; reading
    fields straight off the subquery would run it once per field."""
    out = df.withColumn("_row", one_row(row_df))
    return out.withColumns({c: F.col("_row")[c] for c in row_df.columns}).drop("_row")


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def _num_partitions(df: DataFrame, requested: int | None = None) -> int:
    if requested:
        return requested
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def join_groups(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins one-row-per-group values back to the rows.

    The group table is written first, so its size is known: it is broadcast up
    to BROADCAST_GROUPS rows and joined by shuffle beyond."""
    g = cut_lineage(groups, "groups")
    return df.join(F.broadcast(g) if g.count() <= BROADCAST_GROUPS else g, list(by), how)


#: A key that holds more than one in so many of all rows is hot.
HOT_PARTS = 1000


def join_unique(rows: DataFrame, table: DataFrame, key: str, spread: Sequence[str], parts: int = HOT_PARTS) -> DataFrame:
    """Left join of rows with a table of at most one row per ``key``, whatever share of the rows one key holds.

    Heavy hitters come from the counts per key: at most ``parts`` keys hold more than one in ``parts`` of all rows, so
    naming them to every task is bounded.  Their rows are dealt to several parts by a hash of the columns ``spread``,
    each met by its own copy of the key's row.  Rows of a null key match nothing and bypass the join.
    ``rows`` is read twice, so give a written table."""
    known = rows.where(F.col(key).isNotNull())
    counts = cut_lineage(known.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).scalar()
    hot = cut_lineage(counts.withColumn("_parts", F.ceil(F.col("_n") * parts / total).cast("int")).where(F.col("_parts") > 1).select(key, "_parts"), "hot-keys")
    share = F.coalesce("_parts", F.lit(1))
    dealt = known.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), share).cast("int")).drop("_parts")
    copies = table.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), share - 1))).drop("_parts")
    joined = dealt.join(copies, [key, "_part"], "left").drop("_part")
    return joined.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def prefix_sum(df: DataFrame, order: Sequence[str | Column], weight: str | Sequence[str] | None = None,
               out: str | Sequence[str] = "cum_before", num_partitions: int | None = None,
               keep_partition: str | None = None) -> DataFrame:
    """Adds ``out`` = sum of ``weight`` (1 per row when None) over all rows strictly
    before each row in the global ``order``; several weights share one pass.

    Give a total order (append a unique key) when ties must be broken the same
    way on every run.  Range partitions are summed locally over Arrow batches
    (other columns pass through untouched) and written, which fixes partition
    membership before the offsets, one row per partition, are derived from it.
    ``keep_partition`` names a column for the number of a row's range, ascending in the order.
    """
    outs = [out] if isinstance(out, str) else list(out)
    if weight is None:
        weights = ["_w1"]
        df = df.withColumn("_w1", F.lit(1).cast("bigint"))
    else:
        weights = [weight] if isinstance(weight, str) else list(weight)
        df = df.withColumns({w: F.coalesce(F.col(w).cast("bigint"), F.lit(0).cast("bigint")) for w in weights})
    order_cols = _cols(order)
    # without an explicit count AQE may coalesce the range partitions; coalesced
    # partitions are contiguous key ranges, so partition order stays key order
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols)).sortWithinPartitions(*order_cols)
    locals_ = [f"_local{i}" for i in range(len(weights))]
    schema = StructType(list(ranged.schema.fields) + [StructField("_pid", IntegerType(), False)]
                        + [StructField(c, LongType(), False) for c in locals_])
    names, ws = schema.fieldNames(), list(weights)

    def running(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        carried = [0] * len(ws)
        for batch in batches:
            cols = [*batch.columns, pa.array(np.full(batch.num_rows, pid, np.int32))]
            for i, w in enumerate(ws):
                v = batch.column(w)
                ends = pc.add(pc.cumulative_sum(v), carried[i])
                cols.append(pc.subtract(ends, v))
                if batch.num_rows:
                    carried[i] = ends[-1].as_py()
            yield pa.RecordBatch.from_arrays(cols, names=names)

    local = cut_lineage(ranged.mapInArrow(running, schema), "prefix")
    totals = local.groupBy("_pid").agg(*[F.sum(w).alias(f"_t{i}") for i, w in enumerate(weights)])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: prefix-summed in one task and broadcast
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).cast("bigint").alias(f"_off{i}")
                                      for i in range(len(weights))])
    res = local.join(F.broadcast(offsets), "_pid").withColumns({
        o: (F.col(f"_off{i}") + F.col(f"_local{i}")).cast("bigint") for i, o in enumerate(outs)})
    if keep_partition:
        res = res.withColumn(keep_partition, F.col("_pid"))
    drop = ["_pid", *locals_, *[f"_off{i}" for i in range(len(weights))]] + (["_w1"] if weight is None else [])
    return res.drop(*drop)


def neighbours(df: DataFrame, part: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Adds _prev and _next, the structs ``cols`` of the rows before and after each row in the global order.

    ``df`` lies in ranges of that order, numbered by ``part`` (see prefix_sum).  Neighbours are taken inside
    each range; across ranges the last and first row of each, one row per range, are exchanged."""
    row, at = F.struct(*cols), F.struct(*order)
    inside = Window.partitionBy(part).orderBy(*order)
    d = df.withColumns({"_prev": F.lag(row).over(inside), "_next": F.lead(row).over(inside)})
    ends = df.groupBy(part).agg(F.min_by(row, at).alias("_head"), F.max_by(row, at).alias("_tail"))
    over = Window.orderBy(part)  # one row per range
    ends = ends.select(part, F.lag("_tail").over(over).alias("_tail"), F.lead("_head").over(over).alias("_head"))
    return d.join(F.broadcast(ends), part).withColumns(
        {"_prev": F.coalesce("_prev", "_tail"), "_next": F.coalesce("_next", "_head")}).drop("_tail", "_head")


def round_histogram(df: DataFrame, col: str, max_bins: int) -> DataFrame:
    """Histogram with round bins: the least width of 1, 2 or 5 times a power of ten, bins starting at its multiples,
    that needs at most ``max_bins`` bins.  Rows (bin_lo, bin_hi, count), empty bins kept; one value has one bin of width 1."""
    v = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ends = v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    power = F.floor(F.log10((F.col("_hi") - F.col("_lo")) / F.lit(float(max_bins)))).cast("int")
    widths = F.flatten(F.transform(F.sequence(power - 1, power + 2), lambda k: F.transform(
        F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0)), lambda x: x * F.pow(F.lit(10.0), k))))
    fits = F.filter(widths, lambda w: F.floor(F.col("_hi") / w) - F.floor(F.col("_lo") / w) + 1 <= max_bins)
    width = F.when(F.col("_hi") > F.col("_lo"), F.get(fits, 0)).otherwise(F.lit(1.0))
    plan = ends.where(F.col("_lo").isNotNull()).withColumn("_w", width).withColumns(
        {"_a": F.floor(F.col("_lo") / F.col("_w")), "_b": F.floor(F.col("_hi") / F.col("_w"))})
    w = plan.select("_w").scalar()
    counts = v.groupBy(F.floor(F.col("_v") / w).alias("_i")).agg(F.count(F.lit(1)).alias("count"))
    grid = plan.select("_w", F.explode(F.sequence("_a", "_b")).alias("_i"))
    return grid.join(counts, "_i", "left").select(
        F.round(F.col("_i") * F.col("_w"), 6).alias("bin_lo"), F.round((F.col("_i") + 1) * F.col("_w"), 6).alias("bin_hi"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def global_row_number(df: DataFrame, order: Sequence[str | Column], out: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based position in a global total order, without a single-partition window."""
    r = prefix_sum(df, order, None, "_before", num_partitions)
    return r.withColumn(out, F.col("_before") + F.lit(1)).drop("_before")


#: Low bits of the key that each pass of a selection leaves out: 18 bits are read first, then 16, 16 and 14.
SELECT_SHIFTS = (46, 30, 14, 0)


def order_key(v: Column) -> Column:
    """A 64-bit integer that orders doubles as they are ordered (no NaN): the bits of |v|, negative for v < 0."""
    a = F.abs(v)
    guess = F.least(F.floor(F.log2(a)), F.lit(1023)).cast("int")
    power = F.pow(F.lit(2.0), guess)
    # the logarithm may miss a power of two by one
    e = F.when(power > a, guess - 1).when(a >= 2 * power, guess + 1).otherwise(guess)
    fraction = ((a / F.pow(F.lit(2.0), e) - 1.0) * float(1 << 52)).cast("bigint")
    bits = (F.when(a == float("inf"), F.lit(2047 << 52))
            .when(a >= 2.0 ** -1022, F.shiftleft((e + 1023).cast("bigint"), 52) + fraction)
            .otherwise((a * 2.0 ** 537 * 2.0 ** 537).cast("bigint")))
    return F.when(v < 0, -bits).otherwise(bits)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None, num_partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles (NumPy 'linear', SQL percentile / quantile_cont)
    of ``col`` per group of ``by``; one row per group, one column per probability.

    Nulls and NaN are skipped; a row counts ``weight`` times (once when None).  Position h = p * (n - 1); the result is
    v[floor h] + (v[ceil h] - v[floor h]) * (h - floor h).

    Selection by histogram refinement: a pass counts rows by the leading bits of an order-preserving key,
    for all groups and probabilities at once; the next pass reads only what shares the leading bits of a
    wanted rank, until one value is left (two passes for amounts of money, four at most).  Rows are
    neither sorted nor written; what is shuffled is one row per task and bucket.
    """
    by = list(by)
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    v = F.col(col).cast("double")
    rows = df.select(*by, (v + F.lit(0.0)).alias("_v"), (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("_w")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    if num_partitions:
        rows = rows.repartition(num_partitions)
    rows = rows.withColumn("_key", order_key(F.col("_v")))
    group = Window.partitionBy(*by)
    done = found = None
    for i, shift in enumerate(SELECT_SHIFTS):
        part = rows.withColumn("_b", F.shiftright("_key", shift))
        if found is not None:
            part = join_groups(part.withColumn("_p", F.shiftright("_key", SELECT_SHIFTS[i - 1])),
                               found.where(F.col("_lo") != F.col("_hi")).select(*by, F.col("_b").alias("_p"), "_n", "_targets"), [*by, "_p"])
        inside = [] if found is None else ["_p"]
        counts = part.groupBy(*by, *inside, "_b").agg(
            F.sum("_w").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            *([] if found is None else [F.first("_n").alias("_n"), F.first("_targets").alias("_targets")]))
        # at most 2^18 buckets a group, then 2^16 for a rank
        counts = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*by, *inside).orderBy("_b")) - F.col("_c"))
        if found is None:
            counts = counts.withColumn("_n", F.sum("_c").over(group))
            h = [F.lit(float(p)) * (F.col("_n") - 1).cast("double") for p in probs]
            counts = counts.withColumn("_targets", F.array(*[F.struct(F.lit(k).alias("k"), x.cast("bigint").alias("r"))
                                                             for k, x in enumerate(y for z in h for y in (F.floor(z), F.ceil(z)))]))
        mine = F.filter("_targets", lambda t: (t["r"] >= F.col("_before")) & (t["r"] < F.col("_before") + F.col("_c")))
        counts = counts.withColumn("_targets", F.transform(mine, lambda t: F.struct(t["k"].alias("k"), (t["r"] - F.col("_before")).alias("r"))))
        found = cut_lineage(counts.where(F.size("_targets") > 0).select(*by, "_b", "_n", "_lo", "_hi", "_targets"), "select")
        part_done = found.where(F.col("_lo") == F.col("_hi")).select(*by, "_n", F.explode("_targets.k").alias("_k"), F.col("_lo").alias("_v"))
        done = part_done if done is None else done.unionByName(part_done)
        if found.where(F.col("_lo") != F.col("_hi")).isEmpty():
            break
    agg = done.groupBy(*by).agg(F.first("_n").alias("_n"), *[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"_x{k}") for k in range(2 * len(probs))])
    outs = []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        d = h - F.floor(h)
        lo_v, hi_v = F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}")
        outs.append(F.when(hi_v == lo_v, lo_v).otherwise(lo_v + (hi_v - lo_v) * d).alias(name))
    return agg.select(*by, *outs)


def exact_median_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row frame: exact median of each column (all columns in one selection)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_x")) for c in cols])).alias("_s")
    ).select("_s._col", "_s._x")
    med = exact_quantiles(stacked, "_x", [0.5], by=["_col"], names=["_m"])
    return med.groupBy().pivot("_col", list(cols)).agg(F.first("_m"))


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = (), density: bool = False,
              lo: float | None = None, hi: float | None = None, weight: str | None = None) -> DataFrame:
    """Equal-width histogram on [min, max] (or given [lo, hi]); the last bin is closed; a row counts ``weight`` times.

    Rows: (*by, bin 1..n, bin_lo, bin_hi, count[, density]); empty bins kept.
    A range with min = max is widened by 0.5 on each side.
    """
    by = list(by)
    v = df.select(*by, F.col(col).cast("double").alias("_v"), (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("_w")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if lo is not None and hi is not None:
        v = v.where((F.col("_v") >= lo) & (F.col("_v") <= hi))
        stats = v.groupBy(*by).agg(F.sum("_w").alias("_n"))
        stats = stats.withColumn("_lo", F.lit(float(lo))).withColumn("_hi", F.lit(float(hi)))
    else:
        stats = v.groupBy(*by).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"), F.sum("_w").alias("_n"))
        same = F.col("_mn") == F.col("_mx")
        stats = stats.select(*by, "_n",
                             F.when(same, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                             F.when(same, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    joined = with_row(v, stats) if not by else join_groups(v, stats, by)
    b = F.least(F.floor(F.lit(float(bins)) * (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))) + 1,
                F.lit(bins)).cast("bigint")
    counts = joined.groupBy(*by, b.alias("bin")).agg(F.sum("_w").alias("count"))
    grid = stats.select(*by, "_lo", "_hi", "_n", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    grid = grid.withColumn("bin", F.col("bin").cast("bigint"))
    res = grid.join(counts, [*by, "bin"], "left")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    cols = [*by, "bin",
            F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") - 1) / F.lit(float(bins)), 6).alias("bin_lo"),
            F.round(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / F.lit(float(bins)), 6).alias("bin_hi"),
            F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")]
    if density:
        cols.append(F.round(F.coalesce(F.col("count"), F.lit(0)) / (F.col("_n") * width), 9).alias("density"))
    return res.select(*cols)


def box_stats(df: DataFrame, col: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Box-plot numbers per group: quartiles, 1.5 IQR fences, whisker ends
    (most extreme values inside the fences) and the outlier count; a row counts ``weight`` times."""
    by = list(by)
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], by=by, names=["q1", "median", "q3"], weight=weight)
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumn("fence_lo", F.col("q1") - 1.5 * F.col("iqr")).withColumn("fence_hi", F.col("q3") + 1.5 * F.col("iqr"))
    v = df.select(*by, F.col(col).cast("double").alias("_v"), (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("_w")).where(
        F.col("_v").isNotNull())
    j = with_row(v, q) if not by else join_groups(v, q, by)
    inside = (F.col("_v") >= F.col("fence_lo")) & (F.col("_v") <= F.col("fence_hi"))
    stats = ["q1", "median", "q3", "iqr"]
    agg = j.groupBy(*by).agg(
        F.sum("_w").alias("n"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
        F.sum(F.when(~inside, F.col("_w")).otherwise(0)).cast("bigint").alias("outliers"),
        *[F.first(c).alias(c) for c in stats],
    ).withColumn("n", F.coalesce("n", F.lit(0)))
    return agg.select(*by, "n", *[F.round(c, 6).alias(c) for c in [*stats, "whisker_lo", "whisker_hi"]], "outliers")


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    salt: Sequence[str], out: str = "rank", buckets: int | None = None) -> DataFrame:
    """Exact top-k rows per group by a total ``order``: rank within salted
    sub-groups first (so no group lands whole in one task), then rank the
    survivors (at most k x buckets per group)."""
    group = list(group)
    nb = buckets or _num_partitions(df)
    s = F.pmod(F.xxhash64(*[F.col(c) for c in salt]), F.lit(nb))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    pre = df.withColumn("_salt", s).withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return pre.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k).drop("_salt", "_r1")


def sample_n(df: DataFrame, n: int, salt: str, keys: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Reproducible sample of up to n rows: the n smallest md5(salt|keys) (a top-k); rows of equal
    keys are ordered by the columns ``then``."""
    h = md5_key(salt, *keys)
    return df.withColumn("_h", h).orderBy("_h", *keys, *then).limit(n).drop("_h")
