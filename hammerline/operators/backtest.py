"""Backtests: what the valuation would have said of each sale before it took place."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hammerline.operators import stats, valuation
from hammerline.streaming.streams import shared_dir


class _Past:
    """Sales so far, ordered by price, with their count and weight up to any of them: Fenwick trees over all
    sales of the target, in which those not yet seen count nothing."""

    def __init__(self, prices: list[float]):
        self.prices, self.size, self.n, self.total = prices, len(prices), 0, 0.0
        self.top = 1 << self.size.bit_length() >> 1
        self.counts, self.weights, self.own = [0] * (self.size + 1), [0.0] * (self.size + 1), [0.0] * self.size

    def add(self, at: int, weight: float) -> None:
        self.n, self.total, self.own[at] = self.n + 1, self.total + weight, weight
        k = at + 1
        while k <= self.size:
            self.counts[k] += 1
            self.weights[k] += weight
            k += k & -k

    def below(self, at: int) -> tuple[int, float]:
        """Count and weight of the sales before a place."""
        n, w = 0, 0.0
        while at:
            n, w, at = n + self.counts[at], w + self.weights[at], at & (at - 1)
        return n, w

    def _descend(self, tree: list, most: float) -> int:
        """The first place at which the tree's running sum is above `most`."""
        at, step = 0, self.top
        while step:
            if at + step <= self.size and tree[at + step] <= most:
                at += step
                most -= tree[at]
            step >>= 1
        return at

    def place(self, k: int) -> int:
        return self._descend(self.counts, k)

    def median(self) -> float:
        return (self.prices[self.place((self.n - 1) // 2)] + self.prices[self.place(self.n // 2)]) / 2

    def deviation(self, middle: float) -> float:
        """The median of the distances from the median."""
        left = self.below(bisect_right(self.prices, middle))[0]
        right = self.n - left
        near = lambda k: middle - self.prices[self.place(left - 1 - k)]
        far = lambda k: self.prices[self.place(left + k)] - middle

        def nth(k: int) -> float:
            low, high = max(0, k - right), min(k, left)  # how many of the k nearest lie on the left
            while low < high:
                a = (low + high) // 2
                if near(a) < far(k - a - 1):
                    low = a + 1
                else:
                    high = a
            return min([near(low) for _ in range(low < left)] + [far(k - low) for _ in range(k - low < right)])

        return (nth((self.n - 1) // 2) + nth(self.n // 2)) / 2

    def dispersion(self) -> float | None:
        """Interquartile range over the median, all sales alike; null for one sale or a median of 0."""
        if self.n < 2:
            return None
        q = []
        for p in (0.25, 0.5, 0.75):
            at = min(max(p * self.n - 0.5, 0.0), self.n - 1.0)
            k = min(int(at), self.n - 2)
            a, b = self.prices[self.place(k)], self.prices[self.place(k + 1)]
            q.append(a + (at - k) * (b - a))
        return (q[2] - q[0]) / q[1] if q[1] else None

    def quantiles(self, points: list[float], outside: float, low: float, high: float) -> list[float]:
        """Weighted quantiles (each sale at the middle of its weight) where prices below `low` and above
        `high` weigh `outside` of their weight."""
        a, b = bisect_left(self.prices, low), bisect_right(self.prices, high)
        wa, wb = self.below(a)[1], self.below(b)[1]
        adjusted = lambda w: outside * min(w, wa) + min(max(w - wa, 0.0), wb - wa) + outside * max(w - wb, 0.0)
        own = lambda at: self.own[at] * (1.0 if a <= at < b else outside)
        middle = lambda at: adjusted(self.below(at)[1]) + own(at) / 2
        out = []
        for p in points:
            mass = p * adjusted(self.total)
            base = mass / outside if mass < outside * wa else wa + mass - outside * wa if mass < outside * wa + wb - wa else wb + (mass - outside * wa - wb + wa) / outside
            k = min(self.below(self._descend(self.weights, base))[0], self.n - 1)
            while k > 0 and middle(self.place(k)) > mass:  # one step, but for what rounding does
                k -= 1
            while k + 1 < self.n and middle(self.place(k + 1)) <= mass:
                k += 1
            at = self.place(k)
            if k + 1 == self.n or mass < middle(at):
                out.append(self.prices[at])
            else:
                after = self.place(k + 1)
                out.append(self.prices[at] + (mass - middle(at)) / (middle(after) - middle(at)) * (self.prices[after] - self.prices[at]))
        return out


_FOUND = "n long, exact_count long, strong_count long, houses long, latest_sale date, weighted_median double, p25 double, p75 double, dispersion double"
_KNOWN = f"target_id long, seq long, price double, auction_date date, {_FOUND}"
#: Targets of more sales than this are valued by _Past, which takes n log n steps; smaller ones many at a time, by arrays of n * n.
SMALL = 128
#: Cells of such an array, and rows that are gathered before targets are valued together.
CELLS, GATHERED = 1 << 18, 1 << 17


def _by_order(prices, days, weights, exact, strong, houses, counted) -> list[tuple]:
    """Of one target, in order of price: for each sale the columns of _FOUND, by the sales of earlier days."""
    past, seen, latest, good, out = _Past(prices), set(), None, [0, 0], [None] * len(prices)
    for day, group in groupby(np.argsort(np.array(days), kind="stable").tolist(), key=days.__getitem__):
        known, group = (0, 0, 0, 0, None, None, None, None, None), list(group)
        if past.n:
            low, high = -np.inf, np.inf
            middle = past.median()
            if past.n >= stats.OUTLIER_LEAST and (spread := past.deviation(middle)) > 0:
                low, high = (middle + k * stats.OUTLIER_Z * spread / 0.6745 for k in (-1, 1))
            half, p25, p75 = past.quantiles([0.5, 0.25, 0.75], stats.OUTLIER_WEIGHT, low, high)
            known = (past.n, *good, len(seen), latest, half, p25, p75, past.dispersion())
        for k in group:
            out[k] = known
        for k in group:
            if counted[k]:
                past.add(k, weights[k])
                good = [good[0] + exact[k], good[1] + strong[k]]
                latest = day
                seen |= {houses[k]} - {-1}
    return out


def _by_arrays(prices, days, weights, exact, strong, first_of_house, counted) -> list[np.ndarray]:
    """_by_order for many targets, a row each (short ones are filled with sales that don't count)."""
    seen = counted[:, None, :] & (days[:, None, :] < days[:, :, None])  # target, case, earlier sale
    n = seen.sum(-1)
    counts = np.cumsum(seen, -1, dtype=np.int16)
    among = lambda flags: (seen & flags[:, None, :]).sum(-1)
    target = np.arange(len(prices))[:, None]
    nth = lambda k: prices[target, np.minimum((counts <= k[..., None]).sum(-1), prices.shape[1] - 1)]
    middle = (nth((n - 1) // 2) + nth(n // 2)) / 2
    away = np.sort(np.where(seen, np.abs(prices[:, None, :] - middle[..., None]), np.inf), -1)
    at = lambda k: np.take_along_axis(away, np.maximum(k, 0)[..., None], -1)[..., 0]
    spread = (at((n - 1) // 2) + at(n // 2)) / 2
    reach = np.where((n >= stats.OUTLIER_LEAST) & (spread > 0), stats.OUTLIER_Z * spread / 0.6745, np.inf)
    inside = (prices[:, None, :] >= (middle - reach)[..., None]) & (prices[:, None, :] <= (middle + reach)[..., None])
    own = np.where(seen, weights[:, None, :] * np.where(inside, 1.0, stats.OUTLIER_WEIGHT), 0.0)
    upto = np.cumsum(own, -1)
    places, out = np.where(seen, upto - own / 2, np.inf), []
    for p in (0.5, 0.25, 0.75):
        mass = p * upto[..., -1]
        k = (places <= mass[..., None]).sum(-1) - 1
        j, after = ((counts <= x[..., None]).sum(-1) for x in (np.clip(k, 0, None), np.clip(k + 1, 0, n - 1)))
        j, after = np.minimum(j, prices.shape[1] - 1), np.minimum(after, prices.shape[1] - 1)
        from_, to = (np.take_along_axis(places, x[..., None], -1)[..., 0] for x in (j, after))
        between = (k >= 0) & (k + 1 < n)
        share = np.divide(mass - np.where(between, from_, 0.0), np.where(between, to, 1.0) - np.where(between, from_, 0.0), out=np.zeros_like(mass), where=between)
        out.append(prices[target, j] + share * (prices[target, after] - prices[target, j]))
    quartiles = []
    for p in (0.25, 0.5, 0.75):
        where = np.clip(p * n - 0.5, 0.0, np.maximum(n - 1.0, 0.0))
        k = np.clip(where.astype(np.int64), 0, np.maximum(n - 2, 0))
        low, high = nth(k), nth(k + 1)
        quartiles.append(low + (where - k) * (high - low))
    q1, q2, q3 = quartiles
    ratio = np.divide(q3 - q1, q2, out=np.full_like(q2, np.nan), where=(n >= 2) & (q2 != 0))
    latest = np.where(seen, days[:, None, :], np.iinfo(days.dtype).min).max(-1)
    return [n, among(exact), among(strong), among(first_of_house), latest, *out, ratio]


def _valued(rows: pa.Table) -> pa.Table:
    """Of whole targets, in order of target, price and seq: for each sale with a day, what the sales of earlier days say."""
    code = lambda c: rows[c].combine_chunks().dictionary_encode(null_encoding="encode")
    ids, house, tiers = code("target_id").indices.to_numpy(), rows["house"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(), code("tier")
    prices, days, weights, counted = (rows[c].to_numpy() for c in ("price", "day", "weight", "counts"))
    exact, strong = (tiers.indices.to_numpy() == tiers.dictionary.index(t).as_py() for t in ("EXACT", "STRONG"))
    starts = np.flatnonzero(np.diff(ids, prepend=-1))
    sizes = np.diff(starts, append=len(ids))
    order = np.lexsort((days, house, ids))
    order = order[counted[order] & (house[order] >= 0)]
    new = np.ones(len(order), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (house[order[1:]] != house[order[:-1]])
    first = np.zeros(len(ids), bool)
    first[order[new]] = True  # a house's first sale: as many before a day as there are houses
    found = [np.zeros(len(ids), np.int64 if k < 5 else np.float64) for k in range(9)]
    by_size = np.argsort(sizes, kind="stable")
    small, k = by_size[: np.searchsorted(sizes[by_size], SMALL, "right")], 0
    while k < len(small):
        wide = int(sizes[small[min(len(small), k + max(1, CELLS // int(sizes[small[k]]) ** 2)) - 1]])
        pack = small[k : k + max(1, CELLS // wide**2)]
        wide, k = int(sizes[pack[-1]]), k + len(pack)
        there = np.arange(wide) < sizes[pack][:, None]
        at = np.where(there, starts[pack][:, None] + np.arange(wide), starts[pack][:, None])
        sides = [c[at] for c in (prices, days, weights, exact, strong, first)]
        for column, values in zip(found, _by_arrays(*sides, counted[at] & there)):
            column[at[there]] = values[there]
    for t in by_size[len(small) :]:
        part = slice(starts[t], starts[t] + sizes[t])
        sides = [c[part].tolist() for c in (prices, days, weights, exact, strong, house, counted)]
        for column, values in zip(found, zip(*_by_order(*sides))):
            column[part] = [np.nan if v is None and column.dtype == np.float64 else v or 0 for v in values]
    none = found[0] == 0
    columns = [pa.array(c, mask=none) if k > 4 else pa.array(c) for k, c in enumerate(found)]
    columns[4] = pa.array(found[4].astype(np.int32), mask=none).cast(pa.date32())
    columns[8] = pa.array(found[8], mask=none | np.isnan(found[8]))
    keys = [rows["target_id"].cast(pa.int64()), rows["seq"].cast(pa.int64()), rows["price"], rows["day"].cast(pa.int32()).cast(pa.date32())]
    return pa.Table.from_arrays([*keys, *columns], [c.split()[0] for c in _KNOWN.split(", ")])


def _known_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_valued of sales in order of target, price and seq; a target that goes on in the next batch waits for its rest."""
    held, n, cut = [], 0, 0  # cut: rows of whole targets
    for batch in filter(len, batches):
        ids = batch.column("target_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.diff(ids)) + 1
        if len(starts):
            cut = n + int(starts[-1])
        elif held and held[-1].column("target_id")[-1] != batch.column("target_id")[0]:
            cut = n
        held, n = [*held, batch], n + len(batch)
        if cut and n >= GATHERED:
            table = pa.Table.from_batches(held)
            yield from _valued(table.slice(0, cut)).to_batches()
            held, n, cut = table.slice(cut).to_batches(), n - cut, 0
    if n:
        yield from _valued(pa.Table.from_batches(held)).to_batches()


def run_backtest(comparables: DataFrame, asks: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a case: each sold lot with a price and a day is valued as of its day, by the whole valuation, from
    the earlier sales of its target, the target's asks and its identity_quality, and scored against its own
    price: within says whether that lies in the fair range. Sales of the same day or later are never seen.
    Cases without a value stay, unscored.

    As of a day all recency weights change by one factor, which quantiles don't see, so a sale's weight is
    fixed. Sales go to Python in order of target and price, many targets at a time. Of a target of many sales
    they join an order by price day by day, and each case asks it for what it knows: n log n steps for n sales.
    What needs only sums and joins is columns."""
    price = valuation.effective_price()
    rows = comparables.withColumn("price", price).filter(valuation.realized_eligible() & F.col("auction_date").isNotNull())
    tier = valuation.tier(F.col("identity_match_score"))
    day = F.datediff("auction_date", F.lit("1970-01-01").cast("date"))
    since = F.datediff(F.lit("2000-01-01").cast("date"), "auction_date")
    recency = F.pow(F.lit(0.5), since / float(stats.HALF_LIFE_DAYS))
    weight = F.col("identity_match_score") / 100.0 * recency * valuation.source_weight() * F.coalesce("grade_weight", F.lit(1.0))
    house = F.when(F.length("auction_house") > 0, F.lower(F.trim("auction_house")))
    sales = rows.select("target_id", "seq", "price", day.alias("day"), weight.alias("weight"), tier.alias("tier"), house.alias("house"), (tier != "REJECT").alias("counts"))
    cases = sales.repartition("target_id").sortWithinPartitions("target_id", "price", "seq").mapInArrow(_known_before, _KNOWN)
    dealers = valuation.dealer_market_summary(asks).select("target_id", "dealer_median")
    cases = cases.join(dealers, "target_id", "left").join(targets.select("target_id", "identity_quality"), "target_id", "left")
    valued = valuation.fused(cases.withColumn("identity_quality", F.coalesce("identity_quality", F.lit(0.0))), F.col("auction_date"))
    error = F.when(F.col("price") != 0, F.abs(F.col("price") - F.col("fair_central")) / F.col("price"))
    within = F.when(F.col("fair_central").isNotNull(), F.col("price").between(F.col("fair_low"), F.col("fair_high")))
    return valued.select(
        "target_id", "seq", F.col("n").alias("past_n"), "price", F.col("fair_low").alias("predicted_low"), F.col("fair_central").alias("predicted"), F.col("fair_high").alias("predicted_high"),
        error.alias("pct_error"), F.col("confidence_label").alias("label"), within.alias("within"),
    )


def backtest_report(cases: DataFrame) -> DataFrame:
    """label (null: all), cases, scored, hit_rate, mean_error, upper median error of the scored cases.

    Cases are written to the shared folder once. Errors between two approximate percentiles around the median are
    put in order; errors outside are counted, so the median is exact (were it outside, that side is put in order)."""
    spark = cases.sparkSession
    folder = f"{shared_dir(spark)}/cases-{uuid.uuid4().hex}"
    kept = cases.select("label", "pct_error", F.col("within").cast("double").alias("within"))
    kept.write.parquet(folder)
    kept = spark.read.schema(kept.schema).parquet(folder)
    kept = kept.unionByName(kept.withColumn("label", F.lit(None).cast("string")))
    found = kept.groupBy("label").agg(
        F.count("*").alias("cases"), F.count("pct_error").alias("scored"), F.avg("within").alias("hit_rate"), F.avg("pct_error").alias("mean_error"),
        F.percentile_approx("pct_error", [0.499, 0.501], 10_000).alias("around"),
    )
    of = F.broadcast(found.select(F.col("label").alias("of_label"), F.floor(F.col("scored") / 2).alias("before"), "around"))
    side = F.when(F.col("pct_error") < F.col("around")[0], 0).when(F.col("pct_error") <= F.col("around")[1], 1).otherwise(2)
    sided = kept.filter("pct_error IS NOT NULL").join(of, F.col("label").eqNullSafe(F.col("of_label"))).select("label", "pct_error", "before", side.alias("side"))
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("side"))  # three rows a label
    sides = sided.groupBy("label", "side").agg(F.count("*").alias("n"), F.max("before").alias("before")).withColumn("upto", upto)
    chosen = sides.filter((F.col("upto") - F.col("n") <= F.col("before")) & (F.col("before") < F.col("upto")))
    chosen = F.broadcast(chosen.select(F.col("label").alias("of_label"), F.col("side").alias("of_side"), (F.col("before") - F.col("upto") + F.col("n") + 1).alias("place")))
    near = sided.join(chosen, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("side") == F.col("of_side")))
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("pct_error"))).filter("rn = place")
    medians = near.select(F.col("label").alias("of_label"), F.col("pct_error").alias("median_error"))
    return found.drop("around").join(F.broadcast(medians), F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")


def report_lines(report: DataFrame) -> DataFrame:
    """(label, line): the report as text; a label without scored cases gets no finding."""
    label = F.coalesce("label", F.lit("ALL"))
    none = F.format_string("%s: %d cases, none scored, no finding", label, F.col("cases"))
    line = F.format_string("%s: %d cases, %d scored, %d percent within the range", label, F.col("cases"), F.col("scored"), F.round(F.col("hit_rate") * 100).cast("long"))
    return report.select(label.alias("label"), F.when(F.col("scored") == 0, none).otherwise(line).alias("line"))
