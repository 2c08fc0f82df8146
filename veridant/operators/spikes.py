"""Implausible readings: Hampel filter, run lengths and physical bounds per source.

A reading is doubtful if it is impossible for its quantity, if it leaves for one or two
readings the level that its neighbours hold before and after it, or if it stands still over
many delivered periods of a source that otherwise moves. Levels are rolling medians of the
periods before and after; candidates lie beyond HAMPEL rolling median absolute deviations of the middle of
both, and the stated limit of the quantity settles them. The usual change of a source is a median absolute deviation,
refined to the standard deviation of the changes within it.

Scale: rows are first reduced to distinct (source, period, value), with map-side combination. A
source then has at most as many rows as the calendar has days times its revisions of a
day, however often they were delivered, and that is what one task sees. The verdicts go back
to the rows by an equi-join on source, period and value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Periods on each side whose median is the level there, and the fewest that make one.
REACH, LEAST = 5, 2
#: Median absolute deviations, scaled to standard deviations, beyond which a reading is a candidate.
HAMPEL = 3.0
#: Most readings in a row that can be a spike; more are a lasting change of level.
LONGEST_SPIKE = 2
#: Successive delivered periods with one value that make it stuck.
STUCK_PERIODS = 6
#: A source moves if at most this share of its other changes is zero.
STILL_SHARE = 0.5
#: Changes beyond this many robust deviations are set aside for the usual change.
EXTREME = 6.0
#: Largest deviation from the level: kind of quantity to (scale, limit).
LIMITS = {"price": ("relative", 0.3), "volume": ("factor", 20.0), "level": ("changes", 10.0), "count": ("changes", 10.0), "rate_steps": ("changes", 10.0)}


def is_placeholder(v: np.ndarray) -> np.ndarray:
    """Numbers that stand for a missing one: -999, -99999, 9999999, 999999.99 and the like."""
    a = np.round(np.abs(v), 2)
    whole = np.floor(a)
    frac = np.round(a - whole, 2)
    digits = np.where(whole > 0, np.floor(np.log10(np.maximum(whole, 1))) + 1, 0)
    nines = (whole == 10.0**digits - 1) & np.isin(frac, (0.0, 0.9, 0.99))
    return nines & ((digits >= 6) | ((v < 0) & (digits >= 3)))


def impossible(v: np.ndarray, kind: str) -> np.ndarray:
    bad = is_placeholder(v)
    if kind == "price":
        bad |= v <= 0
    elif kind in ("volume", "count"):
        bad |= v < 0
    return bad


def usual_change(level: np.ndarray) -> float:
    """Standard deviation of the changes between periods, extreme ones set aside."""
    d = np.diff(level)
    d = d[np.isfinite(d)]
    if len(d) < 3:
        return 0.0
    for _ in range(3):
        centre = np.median(d)
        mad = 1.4826 * np.median(np.abs(d - centre))
        if mad == 0:
            moved = np.abs(d[d != centre] - centre)
            mad = np.median(moved) if len(moved) else 0.0
        kept = d[np.abs(d - centre) <= EXTREME * mad] if mad else d
        if len(kept) == len(d):
            break
        d = kept
    return float(np.sqrt(np.mean(d**2))) if len(d) else 0.0


def _row_medians(windows: np.ndarray, least: int) -> np.ndarray:
    """Median of the finite values of each row; NaN with fewer than `least`."""
    ordered = np.sort(windows, axis=1)
    n = np.isfinite(ordered).sum(axis=1)
    rows = np.arange(len(ordered))
    low, high = ordered[rows, np.maximum(n - 1, 0) // 2], ordered[rows, np.minimum(n // 2, ordered.shape[1] - 1)]
    return np.where(n >= least, (low + high) / 2, np.nan)


def _side_medians(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of up to REACH periods before and after each; NaN with fewer than LEAST."""
    n = len(level)
    padded = np.concatenate([np.full(REACH, np.nan), level, np.full(REACH, np.nan)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, REACH)
    return _row_medians(windows[:n], LEAST), _row_medians(windows[REACH + 1 : REACH + 1 + n], LEAST)


def _leaves(x: np.ndarray, at: np.ndarray, kind: str, change: float) -> np.ndarray:
    """Which of x are beyond the limit from the level `at`; none where there is no level."""
    scale, limit = LIMITS[kind]
    with np.errstate(divide="ignore", invalid="ignore"):
        if scale == "relative":
            return np.abs(x - at) > limit * np.abs(at)
        if scale == "factor":
            return (x > limit * at) | (x * limit < at)
        return np.abs(x - at) > limit * change if change > 0 else np.zeros(len(x), bool)


def hampel_band(level: np.ndarray, before: np.ndarray, after: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Middle and spread at each period: the mean of the rolling medians on both sides, and the rolling median absolute deviation from it.

    The spread is that of the REACH periods on each side, or of the whole source where that is less, so that a
    lasting jump nearby hides nothing. Volumes are compared by their logarithms.
    """
    x, low, high = (np.log(np.maximum(v, 1e-9)) if kind == "volume" else v for v in (level, before, after))
    middle = np.where(np.isfinite(low) & np.isfinite(high), (low + high) / 2, np.where(np.isfinite(low), low, high))
    off = np.abs(x - middle)
    overall = np.nanmedian(off) if np.isfinite(off).any() else 0.0
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(off, REACH, constant_values=np.nan), 2 * REACH + 1)
    near = _row_medians(windows, 1)
    spread = np.where(np.isfinite(near), np.minimum(near, overall), overall)
    return middle, 1.4826 * spread


def _outside(x: np.ndarray, middle: np.ndarray, spread: np.ndarray, kind: str) -> np.ndarray:
    """Readings beyond HAMPEL spreads from the middle."""
    v = np.log(np.maximum(x, 1e-9)) if kind == "volume" else x
    return np.abs(v - middle) > HAMPEL * spread


def judge_source(period: np.ndarray, value: np.ndarray, kind: str) -> np.ndarray:
    """Reason (`impossible`, `spike`, `stuck` or empty) of each distinct reading of a source.

    period: whole numbers in order of time, repeated for revisions; value: finite.
    """
    reason = np.full(len(value), "", dtype=object)
    bad = impossible(value, kind)
    reason[bad] = "impossible"
    if bad.all():
        return reason
    periods, of = np.unique(period, return_inverse=True)
    level = _period_medians(of[~bad], value[~bad], len(periods))
    held = np.flatnonzero(np.isfinite(level))
    spot = np.full(len(periods), -1)
    spot[held] = np.arange(len(held))
    # levels are taken over the periods that hold a possible reading
    dense = level[held]
    change = usual_change(dense)
    before, after = _side_medians(dense)
    middle, spread = hampel_band(dense, before, after, kind)
    out = _outside(dense, middle, spread, kind) & _leaves(dense, before, kind, change) & _leaves(dense, after, kind, change)
    # spikes are taken out of their neighbours' levels, then all readings are judged
    clean = np.where(_short_runs(out), np.nan, dense)
    before, after = _side_medians(clean)
    middle, spread = hampel_band(clean, before, after, kind)
    rows = np.flatnonzero(~bad)
    at = spot[of[rows]]
    x = value[rows]
    # the filter finds the candidates, the quantity's own limit from both levels settles them
    odd = _outside(x, middle[at], spread[at], kind) & _leaves(x, before[at], kind, change) & _leaves(x, after[at], kind, change)
    by_period = np.zeros(len(dense), bool)
    np.logical_or.at(by_period, at[odd], True)
    odd &= _short_runs(by_period)[at]
    reason[rows[odd]] = "spike"
    if kind != "rate_steps":
        _mark_stuck(len(periods), of, value, bad, reason)
    return reason


def _period_medians(of: np.ndarray, value: np.ndarray, periods: int) -> np.ndarray:
    """Median of the values of each period; NaN for a period without any."""
    ordered = value[np.lexsort((value, of))]
    n = np.bincount(of, minlength=periods)
    first = np.cumsum(n) - n
    out = np.full(periods, np.nan)
    held = n > 0
    out[held] = (ordered[first[held] + (n[held] - 1) // 2] + ordered[first[held] + n[held] // 2]) / 2
    return out


def _short_runs(flag: np.ndarray) -> np.ndarray:
    """Flags in runs of at most LONGEST_SPIKE."""
    if not flag.any():
        return flag
    out, i = flag.copy(), 0
    while i < len(flag):
        j = i
        while j < len(flag) and flag[j]:
            j += 1
        if j - i > LONGEST_SPIKE:
            out[i:j] = False
        i = max(j, i + 1)
    return out


def _mark_stuck(periods: int, of: np.ndarray, value: np.ndarray, bad: np.ndarray, reason: np.ndarray) -> None:
    """Mark readings of runs of STUCK_PERIODS periods that share a value, but for the first period's.

    A run is a value in successive periods; of: period of each reading, distinct for equal values.
    """
    rows = np.flatnonzero(~bad)
    rows = rows[np.lexsort((of[rows], value[rows]))]
    p, v = of[rows], value[rows]
    opens = np.ones(len(rows), bool)
    opens[1:] = (v[1:] != v[:-1]) | (p[1:] != p[:-1] + 1)
    run = np.cumsum(opens) - 1
    length = np.bincount(run)
    still, moves = len(np.unique(p[~opens])), periods - 1
    inside = int((length[length >= STUCK_PERIODS] - 1).sum())
    if moves - inside <= 0 or (still - inside) > STILL_SHARE * (moves - inside):
        return
    stuck = rows[(length[run] >= STUCK_PERIODS) & ~opens]
    reason[stuck[reason[stuck] == ""]] = "stuck"


def flag_readings(readings: DataFrame, source: list[str], period: str, value: str, kind: Column) -> DataFrame:
    """Rows of `readings` that are doubtful, with `reason`.

    source: columns that name a source; period: a whole number (such as the UTC day) in order
    of time; kind: a key of LIMITS, one for each source: `price` (zero or less is impossible,
    30 % from the level is a spike), `volume` (negative is impossible, a factor of 20),
    `count` (negative is impossible, ten usual changes), `level` (ten usual changes),
    `rate_steps` (as level, but may stand still). Rows with null period, null or NaN value, or
    null kind are not judged. Repeated rows come out as often as they came in.
    """
    r = readings.withColumns({"__kind": kind, "__v": F.col(value).cast("double")}).filter(f"`{period}` IS NOT NULL AND __v IS NOT NULL AND NOT isnan(__v) AND abs(__v) < double('infinity') AND __kind IS NOT NULL")
    # one text stands for the source, so that less goes to Python and back
    name = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"s{i}") for i, c in enumerate(source)]))
    r = r.withColumns({"__s": name, "__p": F.col(period).cast("bigint")})
    cells = r.groupBy("__s", "__p", "__v").agg(F.first("__kind").alias("__kind"))
    kinds = sorted(LIMITS)
    cells = cells.select("__s", "__p", "__v", (F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("__kind")) - 1).cast("int").alias("__kind"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        p, v = pdf["__p"].to_numpy(), pdf["__v"].to_numpy()
        order = np.lexsort((v, p))
        reason = judge_source(p[order], v[order], kinds[pdf["__kind"].iat[0]])
        found = np.flatnonzero(reason != "")
        return pd.DataFrame({"__s": pdf["__s"].iat[0], "__p": p[order[found]], "__v": v[order[found]], "reason": reason[found]})

    found = cells.groupBy("__s").applyInPandas(judge, "__s string, __p bigint, __v double, reason string")
    return r.drop("reason").join(found, ["__s", "__p", "__v"]).drop("__s", "__p", "__v", "__kind")
