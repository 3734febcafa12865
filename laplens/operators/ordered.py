"""Ordered computations over groups of any size.

A plain window puts a whole group in one task. That is right while the largest group is known to
be small, so every entry point first counts rows per group (map-side combined) and uses the plain
window only below ``group_limit``. Larger groups are cut into slices that keep the order:

* :class:`Track` cuts on the clock, halving the width until each slice fits;
* :func:`slice_by_range` range-partitions on (group, order) and holds the sorted copy.

Each slice is scanned on its own and one summary row per slice carries the state over to the next,
so the big side is shuffled once and only the summaries are ordered per group. The scanned slices are
held in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laplens.session import hold

LIMIT_CONF = "laplens.groupLimit"
DEFAULT_LIMIT = 2_000_000
MOST_SLICES = 100_000  # tasks of one range shuffle


def group_limit(df: DataFrame, limit: int | None = None) -> int:
    if limit is not None:
        return limit
    return int(df.sparkSession.conf.get(LIMIT_CONF, str(DEFAULT_LIMIT)))


_SIZES: dict[tuple, tuple] = {}


def _measure(stats: DataFrame) -> tuple:
    """One-row statistics, kept per plan and per set of files read: a table that has grown is measured again."""
    key = (stats.sparkSession.sparkContext.applicationId, stats.semanticHash(), hash(tuple(sorted(stats.inputFiles()))))
    if key not in _SIZES:
        _SIZES[key] = tuple(stats.first())
    return _SIZES[key]


def largest_group(df: DataFrame, keys: list[str]) -> int:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return _measure(counts.agg(F.max("__rows")))[0] or 0


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` that also pairs null keys; the key columns of ``left`` survive."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Group aggregates next to every row, as pre-aggregation plus join (no window over the group)."""
    return join_on(df, df.groupBy(*keys).agg(*aggs), keys)


# ---------------------------------------------------------------------------------------------
# slices


@dataclass
class Sliced:
    """Rows with the columns that place them: group keys, slice (None: whole group), row order."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    slot: str | None = None
    extra: list[str] = field(default_factory=list)

    def finish(self, df: DataFrame) -> DataFrame:
        return df.drop(*([self.slot] if self.slot else []), *self.extra)


def slice_by_range(df: DataFrame, keys: list[str], order: list[Column],
                   limit: int | None = None) -> Sliced | None:
    """None when every group is small enough for a plain window."""
    cap = group_limit(df, limit)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    most, rows = _measure(counts.agg(F.max("__rows"), F.sum("__rows")))
    if (most or 0) <= cap:
        return None
    key_cols = [F.col(k) for k in keys]
    # ranges are cut at sampled places, so they are planned at half of what a slice may hold
    slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * rows // max(cap, 1)))
    ranged = (df.repartitionByRange(min(slices, MOST_SLICES), *key_cols, *order)
              .sortWithinPartitions(*key_cols, *order)
              .withColumn("__part", F.spark_partition_id())
              .withColumn("__pos", F.monotonically_increasing_id()))
    return Sliced(hold(ranged, "ranged"), keys, ["__pos"], "__part", ["__pos"])


# ---------------------------------------------------------------------------------------------
# scans


def last_seen(col: Column, inclusive: bool = True) -> tuple:
    """Latest non-null value up to (or strictly before) the row."""
    return ("last", col, inclusive)


def before(col: Column) -> tuple:
    """Value of the preceding row."""
    return ("lag", col)


def after(col: Column) -> tuple:
    """Value of the following row."""
    return ("lead", col)


def running(col: Column) -> tuple:
    """Running sum including the row."""
    return ("sum", col)


def scan(sl: Sliced, **specs: tuple) -> DataFrame:
    """Add one column per spec; keeps the slice columns so that scans can be chained."""
    cols = [F.col(c) for c in sl.order]
    groups = [*sl.keys, sl.slot] if sl.slot else sl.keys
    w = Window.partitionBy(*groups).orderBy(*cols)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)

    def inside(spec):
        kind, col = spec[0], spec[1]
        if kind == "last":
            return F.last(col, ignorenulls=True).over(upto if spec[2] else earlier)
        if kind == "lag":
            return F.lag(col).over(w)
        if kind == "lead":
            return F.lead(col).over(w)
        return F.sum(col).over(upto)

    if sl.slot is None:
        return sl.df.withColumns({name: inside(spec) for name, spec in specs.items()})

    # in-slice results, the values to hand over, and the first and last row of each slice; held, so that
    # a chain of scans reads every intermediate once instead of once per later step
    inner = {f"__i_{n}": inside(spec) for n, spec in specs.items()}
    for name, spec in specs.items():
        give = {"last": F.last(spec[1], ignorenulls=True).over(upto), "sum": inner[f"__i_{name}"]}
        inner[f"__v_{name}"] = give.get(spec[0], spec[1])
    inner["__head"] = F.lag(F.lit(1)).over(w).isNull()
    inner["__tail"] = F.lead(F.lit(1)).over(w).isNull()
    rows = hold(sl.df.withColumns(inner), "scan")

    ends = rows.filter(F.col("__head") | F.col("__tail"))  # at most two rows per slice
    summary = ends.groupBy(*groups).agg(*[
        F.first(F.when(F.col("__head" if spec[0] == "lead" else "__tail"), F.col(f"__v_{n}")), ignorenulls=True).alias(f"__t_{n}")
        for n, spec in specs.items()])
    wk = Window.partitionBy(*sl.keys).orderBy(sl.slot)
    wk_earlier = wk.rowsBetween(Window.unboundedPreceding, -1)
    carried = {}
    for name, (kind, *_) in specs.items():
        tail = F.col(f"__t_{name}")
        if kind == "last":
            carried[f"__c_{name}"] = F.last(tail, ignorenulls=True).over(wk_earlier)
        elif kind == "lag":
            carried[f"__c_{name}"] = F.lag(tail).over(wk)
        elif kind == "lead":
            carried[f"__c_{name}"] = F.lead(tail).over(wk)
        else:
            carried[f"__c_{name}"] = F.sum(tail).over(wk_earlier)
    carry = summary.withColumns(carried).select(*groups, *carried)

    rows = join_on(rows, carry, groups)
    done = {}
    for name, (kind, *_) in specs.items():
        here, there = F.col(f"__i_{name}"), F.col(f"__c_{name}")
        if kind == "last":
            done[name] = F.coalesce(here, there)
        elif kind == "lag":
            done[name] = F.when(F.col("__head"), there).otherwise(here)
        elif kind == "lead":
            done[name] = F.when(F.col("__tail"), there).otherwise(here)
        else:
            done[name] = F.when(there.isNull(), here).when(here.isNull(), there).otherwise(here + there)
    used = [f"__{p}_{n}" for n in specs for p in ("i", "v", "c")]
    return rows.withColumns(done).drop("__head", "__tail", *used)


class Track:
    """Rows of each group in clock order (``ts`` is a long), cut by the clock where a group is too big.

    The size check runs once, when the track is opened; adding columns keeps its outcome. Rows of one
    group with the same ``ts`` always stay in one slice.
    """

    def __init__(self, df: DataFrame, keys: list[str], ts: str, tie: tuple = (), width: int | None = None):
        self.df, self.keys, self.ts, self.tie, self.width = df, list(keys), ts, tuple(tie), width

    @classmethod
    def open(cls, df: DataFrame, keys: list[str], ts: str, tie: tuple = (), limit: int | None = None) -> Track:
        cap = group_limit(df, limit)
        stats = (df.groupBy(*keys)
                 .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
                 .agg(F.max("n"), F.min("lo"), F.max("hi")))
        most, lo, hi = _measure(stats)
        if not most or most <= cap:
            return cls(df, keys, ts, tie)
        width = max(1, (hi - lo + 1) * cap // most)
        while width > 1:
            slot = F.floor(F.col(ts) / F.lit(width)).alias("__slot")
            if largest_group(df.select(*keys, slot), [*keys, "__slot"]) <= cap:
                break
            width //= 2
        return cls(df, keys, ts, tie, width)

    def _on(self, df: DataFrame) -> Track:
        return Track(df, self.keys, self.ts, self.tie, self.width)

    def derive(self, df: DataFrame, ts: str, keys: list[str] | None = None, tie: tuple = ()) -> Track:
        """Track over events found in this one. They are at most as many as its rows, in every slice, so
        the outcome of the size check holds for them without another pass."""
        return Track(df, keys or self.keys, ts, tie, self.width)

    @property
    def fits(self) -> bool:
        return self.width is None

    def persisted(self) -> Track:
        """Keep the rows for several readers; they stay partitioned by group (and slice)."""
        return self._on(self.df.persist())

    def number(self, rn: str, n: str | None = None) -> Track:
        """1-based position in clock order and group size."""
        out = self.scan(**{rn: running(F.lit(1).cast("long"))})
        if n is None:
            return out
        if self.fits:
            return out.columns(**{n: F.count(F.lit(1)).over(Window.partitionBy(*self.keys))})
        return self._on(with_group_stats(out.df, self.keys, F.count(F.lit(1)).alias(n)))

    def columns(self, **cols: Column) -> Track:
        return self._on(self.df.withColumns(cols))

    def filter(self, cond: Column) -> Track:
        return self._on(self.df.filter(cond))

    def scan(self, **specs: tuple) -> Track:
        order = [self.ts, *self.tie]
        if self.width is None:
            return self._on(scan(Sliced(self.df, self.keys, order), **specs))
        rows = self.df.withColumn("__slot", F.floor(F.col(self.ts) / F.lit(self.width)))
        return self._on(scan(Sliced(rows, self.keys, order, "__slot"), **specs).drop("__slot"))

    def frame(self, lo: int, hi: int, **aggs: Column) -> Track:
        """Aggregates over the rows whose clock lies in [ts+lo, ts+hi]. Where groups are sliced, each
        slice also receives the neighbours its frames reach."""
        if self.width is None:
            w = Window.partitionBy(*self.keys).orderBy(self.ts).rangeBetween(lo, hi)
            return self._on(self.df.withColumns({n: a.over(w) for n, a in aggs.items()}))
        # a slice narrower than the frame would copy rows many times over
        width = F.lit(max(self.width, hi - lo, 1))
        at = F.col(self.ts)
        home = F.floor(at / width)
        reach = F.sequence(F.least(F.floor((at - hi) / width), home), F.greatest(F.floor((at - lo) / width), home))
        spread = self.df.withColumn("__home", home).withColumn("__slice", F.explode(reach))
        w = Window.partitionBy(*self.keys, "__slice").orderBy(self.ts).rangeBetween(lo, hi)
        out = spread.withColumns({n: a.over(w) for n, a in aggs.items()})
        return self._on(out.filter(F.col("__slice") == F.col("__home")).drop("__slice", "__home"))


# ---------------------------------------------------------------------------------------------
# positions


def number(df: DataFrame, keys: list[str], order: list[Column], rn: str | None = "rn",
           n: str | None = None, limit: int | None = None, bound: DataFrame | None = None,
           **stats: Column) -> DataFrame:
    """1-based position ``rn``, group size ``n`` and any group aggregates. ``order`` must be total.

    ``bound``: a frame with the same keys and no fewer rows per group that is cheaper to count than
    ``df`` (for example the table ``df`` was joined from).
    """
    small = bound is not None and largest_group(bound, keys) <= group_limit(df, limit)
    sl = None if small else slice_by_range(df, keys, order, limit)
    if sl is None:
        w = Window.partitionBy(*keys)
        adds = {name: agg.over(w) for name, agg in stats.items()}
        if rn:
            adds[rn] = F.row_number().over(w.orderBy(*order)).cast("long")
        if n:
            adds[n] = F.count(F.lit(1)).over(w)
        return df.withColumns(adds)
    tally = sl.df.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__c"), F.min("__pos").alias("__first"))
    w = Window.partitionBy(*keys)
    seen = w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.withColumns({"__before": F.coalesce(F.sum("__c").over(seen), F.lit(0)),
                               "__n": F.sum("__c").over(w)})
    out = join_on(sl.df, tally, [*keys, "__part"])
    if rn:
        out = out.withColumn(rn, F.col("__before") + F.col("__pos") - F.col("__first") + 1)
    if n:
        out = out.withColumn(n, F.col("__n"))
    if stats:
        out = join_on(out, sl.df.groupBy(*keys).agg(*[a.alias(name) for name, a in stats.items()]), keys)
    return out.drop("__part", "__pos", "__c", "__first", "__before", "__n")


def neighbours(df: DataFrame, keys: list[str], order: list[Column], limit: int | None = None,
               **specs: tuple) -> DataFrame:
    """:func:`before` / :func:`after` / :func:`running` / :func:`last_seen` in any sort order."""
    sl = slice_by_range(df, keys, order, limit)
    if sl is not None:
        return sl.finish(scan(sl, **specs))
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    adds = {}
    for name, (kind, col, *rest) in specs.items():
        adds[name] = {"lag": lambda: F.lag(col).over(w),
                      "lead": lambda: F.lead(col).over(w),
                      "sum": lambda: F.sum(col).over(upto),
                      "last": lambda: F.last(col, ignorenulls=True).over(upto if rest[0] else earlier),
                      }[kind]()
    return df.withColumns(adds)


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rn: str = "rn") -> DataFrame:
    """First ``k`` rows per group. The rank filter sits right on the window, so Spark drops all but
    ``k`` rows of a group in every map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
            .withColumn(rn, F.col(rn).cast("long")))


def keep_one(df: DataFrame, keys: list[str], order: Column, latest: bool = True) -> DataFrame:
    """One row per key, the one with the largest (smallest) ``order``; partial aggregation only."""
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = F.max_by(row, order) if latest else F.min_by(row, order)
    return df.groupBy(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)]) \
             .agg(pick.alias("__row")).select("__row.*")


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], limit: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation between the two nearest positions.

    Equal values are counted before the shuffle, so a frequent value is one row; running counts over the distinct
    values then tell which of them stands at a position. One way for groups of any size.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("__of"))
    placed = join_on(neighbours(counts, keys, [F.col(value)], limit, __upto=running(F.col("__c"))), totals, keys)
    aggs = []
    for name, q in qs.items():
        spot = F.lit(float(q)) * (F.col("__of") - 1)
        at_lo, at_hi = (F.min(F.when(F.col("__upto") > side(spot), F.col(value))) for side in (F.floor, F.ceil))
        aggs.append((at_lo + (at_hi - at_lo) * F.max(spot - F.floor(spot))).alias(name))
    return placed.groupBy(*keys).agg(*aggs)
