"""Implausible readings of measured series, flagged against each series' own habit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import checkpointed


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of the rules (production defaults)."""

    #: Neighbours on each side that make up the level before and after a reading.
    window: int = 8
    #: A reading needs this many neighbours on each side to be held against a level.
    least: int = 3
    #: Probability, per reading, that the fitted tail gives to exceeding the cutoff.
    #: Volume is held to a plainer cutoff, but must also clear ``floor_volume``.
    risk_close: float = 1e-7
    risk_volume: float = 2e-4
    #: Quantile of the standardised residuals above which the tail is fitted.
    tail: float = 0.95
    #: Bounds of the fitted tail's shape.
    shape: tuple[float, float] = (0.0, 0.15)
    #: Least departure (log scale) that can be a spike, of close and of volume.
    floor_close: float = 0.3
    floor_volume: float = 3.6
    #: Least typical deviation (log scale) of a series, so that a quiet one is not held to zero.
    scale_close: float = 0.004
    scale_volume: float = 0.15
    #: A change of the close's level by this much (log scale) is a lasting one...
    level_change: float = 0.12
    #: ...and for so many sessions around it volume may be busier by this much.
    busy_sessions: int = 12
    busy_allowance: float = 0.7
    #: Probability of a run of repeats, by the series' own rate of repeats, at which it is frozen.
    frozen_risk: float = 1e-8
    #: Least length of a frozen run.
    frozen_least: int = 6
    #: Least rate of repeats that a series is taken to have.
    repeat_least: float = 0.01


def _segments(same_as_previous: np.ndarray) -> np.ndarray:
    return np.cumsum(~same_as_previous) - 1


def _neighbours(x: np.ndarray, group: np.ndarray, k: int, side: int) -> np.ndarray:
    """The k non-NULL readings of the same group before (side -1) or after (side 1) each place; x has no NaN."""
    n = len(x)
    out = np.full((n, k), np.nan, np.float32)
    for j in range(1, min(k, n - 1) + 1):
        same = group[j:] == group[:-j]
        if side < 0:
            out[j:, j - 1] = np.where(same, x[:-j], np.nan)
        else:
            out[:-j, j - 1] = np.where(same, x[j:], np.nan)
    return out


def _level(x: np.ndarray, group: np.ndarray, k: int, side: int, least: int) -> np.ndarray:
    """Median of the neighbours on one side; NaN with fewer than ``least``."""
    near = _neighbours(x, group, k, side)
    near.sort(axis=1)  # NaN goes last
    count = k - np.isnan(near).sum(axis=1)
    mid = np.maximum(count - 1, 0)
    rows = np.arange(len(x))
    median = (near[rows, mid // 2] + near[rows, (mid + 1) // 2]) / 2
    return np.where(count >= least, median, np.nan)


def _group_median(x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Median of the finite values of each group, NaN without any."""
    ok = np.isfinite(x)
    order = np.lexsort((x[ok], group[ok]))
    v, g = x[ok][order], group[ok][order]
    size = np.bincount(g, minlength=groups)
    begin = np.append(0, np.cumsum(size))[:-1]
    out = np.full(groups, np.nan)
    has = size > 0
    mid = begin[has] + (size[has] - 1) // 2
    mid2 = begin[has] + size[has] // 2
    out[has] = (v[mid] + v[mid2]) / 2
    return out


def _departure(x: np.ndarray, group: np.ndarray, r: SpikeRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far each reading is off both the level before and the level after it (0 between them), and these levels."""
    before, after = _level(x, group, r.window, -1, r.least), _level(x, group, r.window, 1, r.least)
    a, b = x - before, x - after
    d = np.where(np.sign(a) == np.sign(b), np.where(np.abs(a) < np.abs(b), a, b), 0.0)
    return np.where(np.isfinite(a) & np.isfinite(b), d, np.nan), before, after


def _frozen(x: np.ndarray, group: np.ndarray, groups: int, r: SpikeRules) -> np.ndarray:
    """Which readings are repeats (all but the first) of a run longer than the series' habit explains."""
    n = len(x)
    if n == 0:
        return np.zeros(0, bool)
    same = np.append(False, (group[1:] == group[:-1]) & (x[1:] == x[:-1]))
    run = _segments(same)
    length = np.bincount(run)[run]
    repeats, total = np.bincount(group, weights=same, minlength=groups)[group], np.bincount(group, minlength=groups)[group]
    # the rate without the run itself, and without long runs that could not be a habit by the rate of the others
    odd = length >= r.frozen_least
    while True:
        gone = np.bincount(group, weights=same & odd, minlength=groups)[group] + np.where(odd, 0, length - 1)
        rate = np.maximum((repeats - gone) / np.maximum(total - gone, 1), r.repeat_least)
        rate = np.minimum(rate, 0.999)
        still = odd & ((length - 1) * np.log(rate) < np.log(r.frozen_risk))
        if (still == odd).all():
            return same & odd
        odd = still


def score_series(pdf: pd.DataFrame, r: SpikeRules) -> pd.DataFrame:
    """Candidates and tail counts of whole series, given in order of (ticker, source, day)."""
    key = pdf["ticker"].to_numpy(object), pdf["source"].to_numpy(object)
    new = np.append(True, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) if len(pdf) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    groups = int(group[-1]) + 1 if len(group) else 0
    close, high, low = (pdf[c].to_numpy(float) for c in ("close", "high", "low"))
    volume = pdf["volume"].to_numpy(float)
    listing = pd.factorize(pdf["listing"], use_na_sentinel=True)[0]
    # plausibility: impossible in itself or against its own bar's range
    with np.errstate(invalid="ignore"):
        bad_close = (close <= 0) | (close > high) | (close < low)
        bad_volume = volume < 0
    out = []
    for field, value, bad, floor, least_scale in (("close", close, bad_close, r.floor_close, r.scale_close), ("volume", volume, bad_volume, r.floor_volume, r.scale_volume)):
        impossible = np.flatnonzero(bad)
        out.append(pd.DataFrame({"row": impossible, "field": field, "z": np.inf, "allow": 0.0, "off": np.inf, "sure": True}))
        # stuck: over every reading that was delivered
        there = np.flatnonzero(np.isfinite(value))
        stuck = there[_frozen(np.where(value == 0, np.nan, value)[there] if field == "volume" else value[there], group[there], groups, r)]
        out.append(pd.DataFrame({"row": stuck, "field": field, "z": np.inf, "allow": 0.0, "off": np.inf, "sure": True}))
        # residuals on the log scale over readings above zero
        with np.errstate(invalid="ignore"):
            use = np.flatnonzero((value > 0) & (~bad if field == "close" else True))
        g = group[use]
        x = np.log(value[use])
        if field == "volume":  # weekday season: the median of each weekday against the series' own
            day = pdf["day"].to_numpy()[use] % 7
            base = _group_median(x, g, groups)[g]
            season = _group_median(x - base, g * 7 + day, groups * 7)
            many = np.bincount(g * 7 + day, minlength=groups * 7) >= 20
            x = x - np.where(many, np.nan_to_num(season), 0.0)[g * 7 + day]
        off, before, after = _departure(x, g, r)
        # the typical deviation within each listing of a series
        part = g * (listing.max(initial=0) + 2) + listing[use] + 1
        _, part = np.unique(part, return_inverse=True)
        typical = np.maximum(_group_median(np.where(off == 0, np.nan, np.abs(off)), part, int(part.max(initial=-1)) + 1)[part], least_scale) if len(part) else off
        z = np.abs(off) / typical
        allow = np.zeros(len(use))
        if field == "close":
            step = np.zeros(len(pdf), bool)
            step[use] = np.nan_to_num(np.abs(before - after)) > r.level_change
            reach = np.zeros(len(pdf) + 1)
            hits = np.flatnonzero(step)
            np.add.at(reach, np.maximum(hits - r.busy_sessions, 0), 1)
            np.add.at(reach, np.minimum(hits + r.busy_sessions + 1, len(pdf)), -1)
            busy = np.cumsum(reach)[:-1] > 0
        else:
            allow = np.where(busy[use], r.busy_allowance, 0.0)
        far = np.flatnonzero((np.abs(off) >= floor) & (z >= 3))
        out.append(pd.DataFrame({"row": use[far], "field": field, "z": z[far], "allow": allow[far] / typical[far], "off": np.abs(off[far]), "sure": False}))
        # tail counts per source, on a fixed grid
        ok = np.isfinite(z)
        grid = np.minimum((np.log1p(z[ok]) * 200).astype(int), 4000)
        counted = pd.DataFrame({"source": pdf["source"].to_numpy(object)[use[ok]], "bin": grid}).groupby(["source", "bin"], dropna=False).size().reset_index(name="n")
        out.append(counted.assign(field=field, row=-1))
    got = pd.concat(out, ignore_index=True)
    hit = got["row"] >= 0
    at = got.loc[hit, "row"].astype(int)
    got["ticker"] = None
    got.loc[hit, "ticker"] = pdf["ticker"].to_numpy(object)[at]
    got.loc[hit, "source"] = pdf["source"].to_numpy(object)[at]
    got.loc[hit, "day"] = pdf["day"].to_numpy()[at]
    got["sure"] = got["sure"].eq(True)
    return pd.DataFrame({"ticker": got["ticker"], "source": got["source"], "day": got["day"].astype("Int32"), "field": got["field"], "z": got["z"].astype(float), "allow": got["allow"].astype(float), "off": got["off"].astype(float), "sure": got["sure"], "bin": got["bin"].astype("Int32"), "n": got["n"].astype("Int64")})


_SCORED = "ticker string, source string, day int, field string, z double, allow double, off double, sure boolean, bin int, n long"


def distinct_bars(prices: DataFrame) -> DataFrame:
    """One row per bar (ticker, source, date): each field's newest non-NULL delivery.

    Ties in ``ingested_at`` fold to the greatest value.  The fold has a
    map-side part: a bar delivered very often gathers nowhere.
    """
    at = F.col("ingested_at")
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("x"))))["x"].alias(c)
    rows = prices.where("ticker is not null and date is not null")
    return rows.groupBy("ticker", "source", "date").agg(*(newest(c) for c in ("close", "high", "low", "volume", "listing_id")))


def flag_readings(prices: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """``ticker, source, bar_date DATE, field`` of readings that cannot be true.

    Three rules per series (ticker and source):

    * plausibility: close at or below zero or outside its own bar's range,
      volume below zero;
    * spikes: the log residual of a reading against the levels before and
      after it (volume also against its weekday), divided by the listing's
      typical deviation, exceeds a cutoff.  Cutoffs are fitted per source by
      peaks over threshold: a generalised Pareto tail above the 95 % point
      of all residuals, its shape and scale from tail quantiles (which the
      spikes themselves hardly move), evaluated at a fixed risk.  A lasting
      change of level is no departure, and volume around one may be busier;
    * stuck readings: repeats of one value in a run that the series' own rate
      of repeats makes all but impossible; the first of the run is not flagged.

    Bars are first collapsed over their deliveries, so a series holds at most
    one row per day.  NULL fields are no readings, a NULL source is a source of
    its own, repeated rows change nothing, and an empty table gives an empty
    result.  Other columns of ``prices`` are not looked at.
    """
    bars = distinct_bars(prices).select("ticker", "source", F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), F.col("close").cast("double").alias("close"), F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"), F.col("volume").cast("double").alias("volume"), F.datediff("listing_id", F.lit("1970-01-01").cast("date")).alias("listing"))
    series = bars.repartition("ticker", "source").sortWithinPartitions("ticker", "source", "day")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows < 100_000:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = (whole["ticker"] == whole["ticker"].iloc[-1]) & ((whole["source"] == whole["source"].iloc[-1]) | (whole["source"].isna() & pd.isna(whole["source"].iloc[-1])))
            cut = int(np.argmax(last.to_numpy()))  # the last series may go on in the next batch
            if cut:
                yield score_series(whole.iloc[:cut].reset_index(drop=True), rules)
            held, rows = [whole.iloc[cut:]], len(whole) - cut
        if rows:
            yield score_series(pd.concat(held, ignore_index=True), rules)

    scored = checkpointed(series.mapInPandas(score, _SCORED))
    cutoffs = tail_cutoffs(scored.where("bin is not null"), rules)
    flagged = scored.where("ticker is not null").alias("s").join(F.broadcast(cutoffs).alias("c"), (F.col("s.field") == F.col("c.field")) & F.col("s.source").eqNullSafe(F.col("c.source")), "left")
    flagged = flagged.where("s.sure or s.z - s.allow > c.cutoff")
    return flagged.select("s.ticker", "s.source", F.date_add(F.lit("1970-01-01").cast("date"), F.col("s.day")).alias("bar_date"), "s.field").distinct()


def tail_cutoffs(counts: DataFrame, rules: SpikeRules) -> DataFrame:
    """``source, field, cutoff`` from the counted residuals: one row per source and field.

    The counts lie on a grid of at most 4,001 bins, so what one (source,
    field) brings here is bounded; there are as many results as sources.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.groupby("bin")["n"].sum().sort_index()
        z, share = np.expm1((c.index.to_numpy() + 0.5) / 200), (c.cumsum() / c.sum()).to_numpy()
        at = lambda p: float(z[min(np.searchsorted(share, p), len(z) - 1)])
        p = 1 - rules.tail
        u, e1, e2 = at(1 - p), at(1 - p / 2), at(1 - p / 4)
        first, second = max(e1 - u, 1e-9), max(e2 - e1, 1e-9)
        shape = float(np.clip(np.log2(second / first), *rules.shape))
        scale = first / np.log(2) if abs(shape) < 1e-6 else first * shape / (2**shape - 1)
        risk = rules.risk_close if pdf["field"].iloc[0] == "close" else rules.risk_volume
        rise = np.log(p / risk) if abs(shape) < 1e-6 else ((p / risk) ** shape - 1) / shape
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "field": [pdf["field"].iloc[0]], "cutoff": [u + scale * rise]})

    grid = counts.groupBy("source", "field", "bin").agg(F.sum("n").alias("n"))
    return grid.groupBy("source", "field").applyInPandas(fit, "source string, field string, cutoff double")
