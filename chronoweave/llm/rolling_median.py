"""Exact rolling medians and median absolute deviations over time windows of series.

A series is cut into short panes of time. A pane is a run: its values sorted once. A window is whole panes and
two filtered ones at its edges, so how many of its values lie below a bound is a sum over runs: whole panes come
from counts kept for each run and bound, the edges from counts by place in time and place in the run. Bisection
over the values selects a rank across all runs of a window at once, no runs are merged; likewise over the
distances from the median.

Series are dealt by blocks of time, each with the window before it, so a long series is no single task. Where a
block holds more than ``MOST`` rows its rows are dealt over several tasks; each counts in its own runs, the
counts are summed, and the bisection goes on in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, materialize

WINDOW_US = 15 * 60 * 1_000_000
#: Windows in a block: its rows and those of the window before it are counted in one place.
BLOCK = 2
#: Rows that one task counts in at once.
MOST = 30_000
#: Rows of several small blocks that are worked on together.
TOGETHER = 6_000
#: Bounds that a round of the dealt bisection asks for at once.
PIVOTS = 16
#: Cents beyond this are no exact doubles; such values, like NaN, count as none.
LARGEST = 1 << 52


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of what a timestamp shows, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + second


def cents_of(value: Column) -> Column:
    """``floor(100 * value + 0.5)``; null for null, NaN and values too large to be exact."""
    scaled = 100 * value.cast("double") + 0.5
    return F.when(F.abs(scaled) <= LARGEST, F.floor(scaled))


def _pane_lengths(ts: np.ndarray, window: int) -> Iterator[int]:
    """Lengths of panes that divide the window, from the one that suits the mean density on to finer and coarser ones."""
    sizes = sorted({window // (a * b * c) for a in (1, 2, 3, 4, 6, 8, 12, 16) for b in (1, 5, 25, 125, 625) for c in (1, 64, 3125) if window % (a * b * c) == 0}, reverse=True)
    spread = max(1, len(np.unique(ts // window))) * window
    wanted = spread * max(1.0, np.sqrt(len(ts))) / max(1, len(ts))
    first = int(np.argmin([abs(np.log(s) - np.log(wanted)) for s in sizes]))
    yield sizes[first]
    for step in range(1, len(sizes)):
        for i in (first + step, first - step):
            if 0 <= i < len(sizes):
                yield sizes[i]


class Runs:
    """Values of several units (series and block) as runs by pane, to count in windows.

    ``unit``, ``ts``, ``cents`` of the rows with cents. Kept are, for each pane and value, how many values of
    the panes before are less; and inside a pane, for each time and place in the run, how many of the earlier
    values are in the places before.
    """

    def __init__(self, unit: np.ndarray, ts: np.ndarray, cents: np.ndarray, window: int) -> None:
        self.window = window
        self.values, rank = np.unique(cents, return_inverse=True)
        best = None
        for length in _pane_lengths(ts, window):
            pane = ts // length
            base = int(pane.min()) - 2 * (window // length) - 2 if len(pane) else 0
            width = (int(pane.max()) if len(pane) else 0) - base + window // length + 3
            keys, at, sizes = np.unique(unit * width + (pane - base), return_inverse=True, return_counts=True)
            cost = int(((sizes + 1).astype(np.int64) ** 2).sum()) + (len(keys) + 2) * (len(self.values) + 1)
            if best is None or cost < best[0]:
                best = cost, length, base, width, keys, at, sizes
            if cost <= 8 * len(ts) ** 1.5 + 100_000:
                break
        _, self.length, self.base, self.width, self.keys, at, sizes = best
        n, k = len(self.keys), len(self.values)
        # below[p, j]: values of rank < j in the panes before p; the last pane is empty and stands for those that aren't there.
        held = np.bincount(at * (k + 1) + rank + 1, minlength=n * (k + 1)).reshape(n, k + 1)
        below = np.zeros((n + 2, k + 1), np.int32)
        np.cumsum(np.cumsum(held, axis=1), axis=0, out=below[1 : n + 1])
        below[n + 1] = below[n]
        self.below, self.stride = below.ravel(), k + 1
        # earlier[p][e, s]: of a pane's first e values by time those in the first s places of its run.
        by_time = np.lexsort((ts, at))
        self.sizes = np.append(sizes, 0)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        self.first, self.times = starts, ts[by_time]
        in_run = np.empty(len(ts), np.int64)
        by_value = np.lexsort((rank, at))
        in_run[by_value] = np.arange(len(ts)) - starts[at[by_value]]
        area = (self.sizes + 1) ** 2
        self.corner = np.concatenate([[0], np.cumsum(area)])[:-1]
        earlier = np.zeros(int(area.sum()), np.int32)
        p = at[by_time]
        e = np.arange(len(ts)) - starts[p]
        earlier[self.corner[p] + (e + 1) * (self.sizes[p] + 1) + in_run[by_time] + 1] = 1
        for size in np.unique(sizes):
            where = self.corner[:-1][sizes == size]
            cells = where[:, None] + np.arange((size + 1) ** 2)
            grid = earlier[cells].reshape(len(where), size + 1, size + 1)
            earlier[cells] = np.cumsum(np.cumsum(grid, axis=1), axis=2).reshape(len(where), -1)
        self.earlier = earlier

    def windows(self, unit: np.ndarray, ts: np.ndarray) -> Windows:
        return Windows(self, unit, ts)


class Windows:
    """The windows that end at ``ts`` of ``unit``: counts of their values below a bound."""

    def __init__(self, runs: Runs, unit: np.ndarray, ts: np.ndarray) -> None:
        r = self.runs = runs
        empty, panes = len(r.keys), r.window // r.length
        # Windows that end before all values or begin after them are empty wherever they lie.
        ts = np.clip(ts, r.times.min() - 1, r.times.max() + r.window) if empty else ts
        key = unit * r.width + np.maximum(ts // r.length - r.base, 0)
        self.hi = np.searchsorted(r.keys, key)
        left = np.searchsorted(r.keys, np.maximum(key - panes, unit * r.width))
        there = lambda i, k: (i < empty) & (r.keys[np.minimum(i, max(0, empty - 1))] == k) if empty else np.zeros(len(k), bool)
        has_left = there(left, key - panes)
        self.lo = left + has_left
        self.right = np.where(there(self.hi, key), self.hi, empty)
        self.left = np.where(has_left, left, empty)
        self.up_to = self._placed(self.right, ts)
        self.gone = self._placed(self.left, ts - r.window)

    def _placed(self, pane: np.ndarray, ts: np.ndarray) -> np.ndarray:
        """How many values of a pane are at or before ``ts``: bisection in the pane's times."""
        r = self.runs
        a, size = r.first[np.minimum(pane, len(r.keys))], r.sizes[pane]
        lo, hi = np.zeros(len(ts), np.int64), size.astype(np.int64).copy()
        while len(r.times) and (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            late = r.times[np.minimum(a + mid, len(r.times) - 1)] <= ts
            lo, hi = np.where(open_ & late, mid + 1, lo), np.where(open_ & ~late, mid, hi)
        return lo

    def below(self, j: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """How many values have a rank less than ``j``, for the windows ``at``."""
        r, k = self.runs, self.runs.stride
        hi, lo, right, left = self.hi[at], self.lo[at], self.right[at], self.left[at]
        out = r.below[hi * k + j] - r.below[lo * k + j]
        s = r.below[(right + 1) * k + j] - r.below[right * k + j]
        out += r.earlier[r.corner[right] + self.up_to[at] * (r.sizes[right] + 1) + s]
        s = r.below[(left + 1) * k + j] - r.below[left * k + j]
        return out + s - r.earlier[r.corner[left] + self.gone[at] * (r.sizes[left] + 1) + s]

    def up_to_value(self, v: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.below(np.searchsorted(self.runs.values, v, "right"), at)

    def within(self, centre2: np.ndarray, d: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """How many values c have |2c - centre2| <= d."""
        v = self.runs.values
        upper, lower = np.searchsorted(v, (centre2 + d) >> 1, "right"), np.searchsorted(v, -((d - centre2) >> 1), "left")
        return np.where(d < 0, 0, self.below(np.maximum(upper, lower), at) - self.below(lower, at))

    def size(self) -> np.ndarray:
        return self.below(np.full(len(self.hi), len(self.runs.values)))


def least_reaching(count: Callable[[np.ndarray, np.ndarray], np.ndarray], wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least x in [lo, hi] with ``count(x, i) >= wanted[i]``, for all i at once; it has to hold at hi."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        met = count(mid, open_) >= wanted[open_]
        hi[open_[met]] = mid[met]
        lo[open_[~met]] = mid[~met] + 1
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def medians(w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window the number of values, the doubled median and the doubled median of doubled distances from it; 0 where it is empty."""
    v = w.runs.values
    n = w.size().astype(np.int64)
    median2, mad4 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    some = np.flatnonzero(n > 0)
    if not len(some):
        return n, median2, mad4

    def two_middle(count, lo, hi):
        """The sum of the two middle ones; the second is looked for only where the first one's count doesn't reach it."""
        k, k2 = (n[some] + 1) // 2, n[some] // 2 + 1
        one = least_reaching(lambda x, i: count(x, some[i], i), k, lo, hi)
        far = np.flatnonzero(count(one, some, slice(None)) < k2)
        two = one.copy()
        two[far] = least_reaching(lambda x, i: count(x, some[far[i]], far[i]), k2[far], one[far] + 1, hi[far])
        return one, two

    last = np.full(len(some), len(v) - 1)
    a, b = two_middle(lambda x, at, _: w.below(x + 1, at), np.zeros(len(some), np.int64), last)
    m2 = v[a] + v[b]
    reach = np.maximum(2 * v[-1] - m2, m2 - 2 * v[0])
    a, b = two_middle(lambda x, at, i: w.within(m2[i], x, at), np.zeros(len(some), np.int64), reach)
    median2[some], mad4[some] = m2, a + b
    return n, median2, mad4


def _units(kind: pa.Array, block: pa.Array) -> np.ndarray:
    """Numbers of rows' units: a new one wherever series or block change."""
    k = kind.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    b = block.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (b[1:] != b[:-1]))]) if len(k) else np.zeros(0, np.int64)


def _whole_units(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units, of about ``limit`` rows; rows come sorted by series and block."""
    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows < limit:
            continue
        held = held.combine_chunks()
        unit = _units(held["series"].combine_chunks(), held["block"].combine_chunks())
        start = 0
        firsts = np.flatnonzero(np.diff(unit)) + 1
        while len(firsts) and held.num_rows - start >= limit:
            after = firsts[firsts > start]
            if not len(after):
                break
            stop = int(after[min(int(np.searchsorted(after, start + limit)), len(after) - 1)])
            yield held.slice(start, stop - start).combine_chunks(), unit[start:stop]
            start = stop
        held = held.slice(start)
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield held, _units(held["series"].combine_chunks(), held["block"].combine_chunks())


def _column(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values, and which of them are there."""
    c = t[name].combine_chunks()
    c = c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)
    return c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), c.is_valid().to_numpy(zero_copy_only=False)


FOUND = "click_id {id}, series string, n long, median2 long, mad4 long, far boolean"


def _local(dealt: DataFrame, window: int) -> DataFrame:
    """Results of rows ``(click_id, series, block, own, us, cents)`` whose units fit into one task; a unit's rows lie together."""
    schema = FOUND.format(id=dealt.schema["click_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, unit in _whole_units(batches, TOGETHER):
            unit = unit - unit[0]
            us, _ = _column(t, "us")
            cents, has = _column(t, "cents")
            own = t["own"].to_numpy().astype(bool)
            w = Runs(unit[has], us[has], cents[has], window).windows(unit[own], us[own])
            n, median2, mad4 = medians(w)
            none, mine = n < 1, pa.array(own)
            c, c_has = cents[own], has[own]
            far = 2 * np.abs(2 * c - median2) > 2 * mad4
            yield pa.RecordBatch.from_arrays(
                [t["click_id"].combine_chunks().filter(mine), t["series"].combine_chunks().filter(mine), pa.array(n), pa.array(median2, mask=none), pa.array(mad4, mask=none), pa.array(far, mask=none | ~c_has)],
                names=["click_id", "series", "n", "median2", "mad4", "far"],
            )

    return dealt.mapInArrow(run, schema)


def _counts(rows: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """``asked (unit, us, k, m2, p array<long>, parts, pieces)`` with ``counts``: how many values of each window are at most each of ``p``, or with an ``m2`` no farther from it than that.

    Rows ``(unit, part, piece, us, cents)``: each part of a unit's rows counts for each piece of its queries, then counts are summed.
    """
    import pandas as pd

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return right[["unit", "us", "k"]].assign(counts=pd.Series([], dtype=object))
        zeros = lambda x: np.zeros(len(x), np.int64)
        w = Runs(zeros(left), left["us"].to_numpy(np.int64), left["cents"].to_numpy(np.int64), window).windows(zeros(right), right["us"].to_numpy(np.int64))
        centred, m2 = right["m2"].notna().to_numpy(), right["m2"].fillna(0).to_numpy(np.int64)
        counts = [np.where(centred, w.within(m2, x), w.up_to_value(x)) for x in np.stack(right["p"].to_numpy()).astype(np.int64).T]
        return pd.DataFrame({"unit": right["unit"], "us": right["us"], "k": right["k"], "counts": np.stack(counts, axis=1).tolist()})

    sent = asked.select("unit", "us", "k", "m2", "p", F.pmod(F.xxhash64("us"), "pieces").alias("piece"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    by = ["unit", "part", "piece"]
    counted = rows.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(count, "unit long, us long, k long, counts array<long>")
    width = asked.select(F.max(F.size("p"))).first()[0] or 0
    sums = F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(width)]) if width else F.array().cast("array<long>")
    return asked.join(counted.groupBy("unit", "us", "k").agg(sums.alias("counts")), ["unit", "us", "k"])


def _selected(rows: DataFrame, state: DataFrame, window: int) -> DataFrame:
    """The values of rank ``k`` of ``state (unit, us, k, m2, lo, hi, parts, pieces)`` as ``(unit, us, k, value)``; each round narrows lo to hi to the gap between two of PIVOTS bounds."""
    state = materialize(state, "median-state")
    while state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]:
        bounds = F.expr(f"transform(sequence(1, {PIVOTS}), i -> lo + (hi - lo) div {PIVOTS} * i + (hi - lo) % {PIVOTS} * i div {PIVOTS})")
        found = _counts(rows, state.withColumn("p", bounds), window)
        first = F.expr("array_position(transform(counts, n -> n >= k), true) - 1").cast("int")
        now = found.withColumn("f", first).withColumns({"lo": F.when(F.col("f") > 0, F.get("p", F.col("f") - 1) + 1).otherwise(F.col("lo")), "hi": F.get("p", F.col("f"))})
        old, state = state, materialize(now.select(*state.columns), "median-state")
        drop_stored(old)
    return state.select("unit", "us", "k", F.col("lo").alias("value"))


def _middle(rows: DataFrame, queries: DataFrame, window: int) -> DataFrame:
    """The sum of the two middle values of each of ``queries (unit, us, n, m2, lo, hi, parts, pieces)``, as ``(unit, us, middle)``."""
    ranks = F.array_distinct(F.array(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")))
    found = _selected(rows, queries.select("unit", "us", F.explode(ranks).alias("k"), "m2", "lo", "hi", "parts", "pieces"), window)
    return found.groupBy("unit", "us").agg((F.sum("value") * F.when(F.count(F.lit(1)) == 1, 2).otherwise(1)).alias("middle"))


def _dealt_over(dealt: DataFrame, dense: DataFrame, window: int) -> DataFrame:
    """Results of the rows of ``dense (series, block, unit, parts, pieces)`` blocks, whose rows are dealt over tasks: copies of a block's rows meet all pieces of its queries."""
    held = materialize(dealt.join(dense, ["series", "block"]), "median-dense")
    part = F.pmod(F.xxhash64("click_id", "us"), "parts")
    rows = held.where("cents is not null").select("unit", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "us", "cents")
    bounds = held.groupBy("unit").agg(F.min("cents").alias("lo"), F.max("cents").alias("hi"))
    asked = held.where("own").select("unit", "us", "parts", "pieces").distinct().join(bounds, "unit").where("lo is not null")
    asked = asked.withColumns({"k": F.lit(0).cast("long"), "m2": F.lit(None).cast("long"), "p": F.array("hi")})
    sized = _counts(rows, materialize(asked, "median-asked"), window)
    sized = materialize(sized.select("unit", "us", F.get("counts", F.lit(0)).alias("n"), "m2", "lo", "hi", "parts", "pieces").where("n > 0"), "median-sized")
    middle = sized.join(_middle(rows, sized, window).withColumnRenamed("middle", "median2"), ["unit", "us"])
    reach = F.greatest(2 * F.col("hi") - F.col("median2"), F.col("median2") - 2 * F.col("lo"))
    middle = materialize(middle.withColumns({"m2": F.col("median2"), "lo": F.lit(0).cast("long"), "hi": reach}), "median-centred")
    both = middle.join(_middle(rows, middle, window).withColumnRenamed("middle", "mad4"), ["unit", "us"]).select("unit", "us", "n", "median2", "mad4")
    c = F.col("cents")
    return held.where("own").join(both, ["unit", "us"], "left").select("click_id", "series", F.coalesce("n", F.lit(0)).alias("n"), "median2", "mad4", (2 * F.abs(2 * c - F.col("median2")) > 2 * F.col("mad4")).alias("far"))


def rolling_medians(events: DataFrame, key: str = "click_id", ts: str = "ts", series: str = "kind", value: str = "value", first: str | None = "arrived_at", window_us: int = WINDOW_US, most: int = MOST) -> DataFrame:
    """Rows ``(key, series, n, median2, mad4, far)`` of each event: of the values, in cents, of its series in the window that ends at it.

    The window holds the events with ``ts`` more than the event's own minus ``window_us`` and at most its own, all
    that share its ``ts`` included. ``n`` counts them, ``median2`` is their doubled median, ``mad4`` the doubled median of
    ``|2c - median2|``, ``far`` whether the event's own value is more than the deviation away. Without values in the window
    all but ``n`` are null; ``far`` is null without a value of its own.

    Of rows that share a key one counts: the first by ``first`` (nulls first), among those with a ``ts`` if any has
    one; rows without a key are one event. Events without ``ts`` go. A null series is a series. A null, NaN, infinite
    or inexactly large value is none. An empty table gives an empty one. Further columns of events are ignored. Blocks of
    more than ``most`` rows are dealt over tasks; the results are the same.
    """
    us, cents = micros(F.col(ts)), cents_of(F.col(value))
    named = F.when(F.col(series).isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), F.col(series).cast("string")))
    read = events.select(F.col(key).alias("click_id"), (F.col(first) if first else F.lit(0)).alias("at"), us.alias("us"), named.alias("series"), cents.alias("cents"))
    once = read.groupBy("click_id").agg(F.min(F.struct(F.col("us").isNull().alias("no"), "at", "us", "series", "cents")).alias("e")).where("e.us is not null")
    once = materialize(once.select("click_id", "e.series", "e.us", "e.cents"), "clicks-once")
    length = BLOCK * window_us
    block = F.expr(f"(us - pmod(us, {length})) div {length}")
    reaches = (F.pmod(F.col("us"), F.lit(length)) > length - window_us) & F.col("cents").isNotNull()
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    after = F.struct((block + 1).alias("block"), F.lit(False).alias("own"))
    dealt = once.select("click_id", "series", "us", "cents", F.inline(F.when(reaches, F.array(own, after)).otherwise(F.array(own))))
    parts = F.ceil(F.col("rows") / most).cast("long")
    dense = dealt.groupBy("series", "block").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most)
    dense = materialize(dense.select("series", "block", F.monotonically_increasing_id().alias("unit"), parts.alias("parts"), parts.alias("pieces")), "dense-blocks")
    some = not dense.isEmpty()
    thin = dealt.join(dense, ["series", "block"], "left_anti") if some else dealt
    found = _local(thin.repartition("series", "block").sortWithinPartitions("series", "block"), window_us)
    if some:
        found = found.unionByName(_dealt_over(dealt, dense, window_us))
    kind = F.when(F.col("series") != "n", F.substring("series", 2, 1 << 30)).alias(series)
    return found.select(F.col("click_id").alias(key), kind, "n", "median2", "mad4", "far")


#: For tables of some thousand rows: the windows are lists.
OP11_SQL = """WITH once AS (
  SELECT click_id, kind, value, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY ts IS NULL, arrived_at NULLS FIRST, ts, kind NULLS FIRST, value NULLS FIRST) AS r FROM clicks) WHERE r = 1 AND ts IS NOT NULL),
c AS (SELECT *, CASE WHEN abs(100 * value + 0.5) <= 4503599627370496 THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents FROM once),
w AS (SELECT click_id, kind, cents, list_sort(list(cents) FILTER (cents IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL '899.999999 seconds' PRECEDING AND CURRENT ROW)) AS l FROM c),
m AS (SELECT click_id, kind, cents, l, coalesce(len(l), 0) AS n, l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] AS median2 FROM w),
d AS (SELECT *, list_sort(list_transform(l, lambda x: abs(2 * x - median2))) AS far_by FROM m),
f AS (SELECT *, far_by[(n + 1) // 2] + far_by[n // 2 + 1] AS mad4 FROM d)
SELECT click_id, kind, CAST(n AS BIGINT) AS n, median2, mad4, 2 * abs(2 * cents - median2) > 2 * mad4 AS far FROM f"""
