"""Irregular readings onto a regular grid, filled by a continuous-time Kalman smoother.

Each source follows a local linear trend: a level and a slope that drift with elapsed time,
seen through noise. The filter runs over the actual times of the readings and the grid
times, the smoother goes back over both; at each grid time there is a value with its
standard error, and a flag if the period holds no reading. The split of the variance into
noise and drift is the one of greatest likelihood out of a few.

Scale: readings are reduced to one per source and instant, with map-side combination, and
sorted by source; a task streams over its sources and holds one batch of them, or a piece of a longer one. The series of a
batch go through filter and smoother together, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridant.functions.periods import period_day

#: Shares of the variance of changes: observation noise, level drift, slope drift.
SPLITS = ((0.05, 0.9, 1e-3), (0.25, 0.4, 1e-4), (0.45, 0.05, 1e-4), (0.5, 1e-3, 1e-6))
#: Readings gathered for a batch, and steps times series that are smoothed together.
BATCH_ROWS, BATCH_CELLS = 50_000, 500_000
#: Readings from which a source is smoothed in pieces, and by how many the pieces overlap: far more than a smoother looks back.
LONG_SOURCE, OVERLAP = 250_000, 2_000
#: Nominal length of a period in days.
PERIOD_DAYS = {"D": 1.4, "W": 7.0, "M": 30.4, "Q": 91.3}


def grid_days(first: np.datetime64, last: np.datetime64, code: str) -> np.ndarray:
    """First days of all periods from the one of `first` to the one of `last`."""
    if code == "D":
        days = np.arange(first, last + 1)
        return days[(days.astype("datetime64[D]").view("int64") + 3) % 7 < 5]
    if code == "W":
        return np.arange(first, last + 1, 7)
    months = np.arange(first.astype("datetime64[M]"), last.astype("datetime64[M]") + 1, 3 if code == "Q" else 1)
    return months.astype("datetime64[D]")


def _filter(t: np.ndarray, y: np.ndarray, noise: np.ndarray, drift: np.ndarray, bend: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Log likelihoods of the local linear trends and, if `keep`, predicted and filtered states at each step.

    t, y: times and readings by step and series; the parameters have the series last, and splits of the variance before it.
    All series of a batch advance together, step by step.
    """
    seen = np.isfinite(y)
    first = np.take_along_axis(y, seen.argmax(axis=0)[None], axis=0)[0]
    shape = noise.shape
    level, slope = np.broadcast_to(first, shape).copy(), np.zeros(shape)
    a, b, c = 1e6 * (noise + drift) + 1e-12, np.zeros(shape), noise + drift
    steps, total = [], np.zeros(shape)
    elapsed = np.diff(t, axis=0, prepend=t[:1])
    filled = np.where(seen, y, 0.0)
    for k in range(len(t)):
        d = elapsed[k]
        level = level + slope * d
        a, b, c = a + 2 * d * b + d * d * c + drift * d + bend * d**3 / 3, b + d * c + bend * d * d / 2, c + bend * d
        predicted = (level, slope, a, b, c, d)
        if seen[k].any():
            s = a + noise
            e = filled[k] - level
            total -= np.where(seen[k], 0.5 * (np.log(s) + e * e / s), 0.0)
            g, h = np.where(seen[k], a / s, 0.0), np.where(seen[k], b / s, 0.0)
            level, slope = level + g * e, slope + h * e
            a, b, c = (1 - g) * a, (1 - g) * b, c - h * b
        if keep:
            steps.append((predicted, (level, slope, a, b, c)))
    return total, steps


def _smooth_batch(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed levels and standard errors by step and series; the split of the variance is chosen for each series."""
    var = np.empty(t.shape[1])
    for i in range(t.shape[1]):
        seen = y[np.isfinite(y[:, i]), i]
        change = np.diff(seen)
        size = np.median(np.abs(change)) * 1.4826 if len(change) else 0.0
        if size == 0.0 and len(change):
            size = float(np.std(change))
        var[i] = max(size**2, (1e-6 * np.max(np.abs(seen))) ** 2, 1e-18)
    options = np.maximum(np.array(SPLITS).T[:, :, None] * var, 1e-24)
    best = _filter(t, y, *options, keep=False)[0].argmax(axis=0)
    steps = _filter(t, y, *np.take_along_axis(options, best[None, None], axis=1)[:, 0], keep=True)[1]
    mean, error = np.empty(t.shape), np.empty(t.shape)
    level, slope, a, b, c = steps[-1][1]
    mean[-1], error[-1] = level, np.sqrt(np.maximum(a, 0.0))
    for i in range(len(t) - 2, -1, -1):
        pl, ps, pa, pb, pc, d = steps[i + 1][0]
        fl, fs, fa, fb, fc = steps[i][1]
        det = pa * pc - pb * pb
        sound = det > 1e-300
        det = np.where(sound, det, 1.0)
        # gain = filtered covariance x transition' x inverse of predicted covariance
        u, v, w, x = fa + d * fb, fb, fb + d * fc, fc
        g00, g01 = np.where(sound, (u * pc - v * pb) / det, 0.0), np.where(sound, (v * pa - u * pb) / det, 0.0)
        g10, g11 = np.where(sound, (w * pc - x * pb) / det, 0.0), np.where(sound, (x * pa - w * pb) / det, 0.0)
        dl, ds, da, db, dc = level - pl, slope - ps, a - pa, b - pb, c - pc
        level, slope = fl + g00 * dl + g01 * ds, fs + g10 * dl + g11 * ds
        a, b, c = (
            fa + g00 * g00 * da + 2 * g00 * g01 * db + g01 * g01 * dc,
            fb + g00 * g10 * da + (g00 * g11 + g01 * g10) * db + g01 * g11 * dc,
            fc + g10 * g10 * da + 2 * g10 * g11 * db + g11 * g11 * dc,
        )
        mean[i], error[i] = level, np.sqrt(np.maximum(a, 0.0))
    return mean, error


def smooth_many(series: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """`smooth` of many series, in batches of like length whose padding is bounded."""
    out: list = [None] * len(series)
    order = sorted(range(len(series)), key=lambda i: len(series[i][0]))
    while order:
        steps = len(series[order[-1]][0])
        batch = [i for i in order[-max(1, BATCH_CELLS // steps) :] if 2 * len(series[i][0]) >= steps]
        del order[-len(batch) :]
        t = np.column_stack([np.pad(series[i][0], (0, steps - len(series[i][0])), mode="edge") for i in batch])
        y = np.column_stack([np.pad(series[i][1], (0, steps - len(series[i][1])), constant_values=np.nan) for i in batch])
        mean, error = _smooth_batch(t, y)
        for k, i in enumerate(batch):
            n = len(series[i][0])
            out[i] = (mean[:n, k], error[:n, k])
    return out


def smooth(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its standard error at each time; y is NaN where nothing was read.

    t: increasing, in periods. A single reading gives that value with an error growing away
    from it.
    """
    return smooth_many([(t, y)])[0]


def fill_sources(pdf: pd.DataFrame) -> pd.DataFrame:
    """The grids of the whole sources in `pdf`: source, code, day, sec, prefer, value, in order of source and sec."""
    grids, series, spots = [], [], []
    for (source, code), g in pdf.groupby(["source", "code"], sort=False):
        days, sec, value = g["day"].to_numpy().astype("datetime64[D]"), g["sec"].to_numpy(), g["value"].to_numpy()
        grid = grid_days(days.min(), days.max(), code)
        low, high = g["low"].iat[0], g["high"].iat[-1]
        mine = np.ones(len(grid), bool) if low is None else grid >= np.datetime64(low, "D")
        mine &= True if high is None else grid < np.datetime64(high, "D")
        at = grid.astype("int64") * 86400
        t = np.concatenate([at, sec]) / (PERIOD_DAYS[code] * 86400)
        by_time = np.argsort(t, kind="stable")
        series.append((t[by_time], np.concatenate([np.full(len(at), np.nan), value])[by_time]))
        back = np.empty(len(t), int)
        back[by_time] = np.arange(len(t))
        spots.append(back[: len(at)])
        # of the readings of a period, the one preferred last
        last = pd.DataFrame({"day": days, "prefer": g["prefer"].fillna("").astype(str).to_numpy(), "value": value}).sort_values(["day", "prefer", "value"], kind="stable").drop_duplicates("day", keep="last")
        read = np.full(len(grid), np.nan)
        read[np.searchsorted(grid, last["day"].to_numpy().astype("datetime64[D]"))] = last["value"].to_numpy()
        grids.append((source, grid, read, mine))
    smoothed = smooth_many(series)
    parts = [
        pd.DataFrame({"source": source, "period_start": grid.astype(object), "reading": read, "missing": np.isnan(read), "smoothed": mean[spot], "std_error": error[spot]})[mine]
        for (source, grid, read, mine), (mean, error), spot in zip(grids, smoothed, spots, strict=True)
    ]
    return pd.concat(parts, ignore_index=True)


def _whole_sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in order of source, joined and parted anew so that each holds whole sources, of BATCH_ROWS rows or one source.

    A source of more than LONG_SOURCE readings comes in pieces that overlap by OVERLAP readings on both sides of the day where
    they part; `low` of the first row and `high` of the last say which grid days a piece is for.
    """
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        held.append(pdf.assign(low=None, high=None))
        rows += len(pdf)
        if rows < min(BATCH_ROWS, LONG_SOURCE):
            continue
        joined = pd.concat(held, ignore_index=True)
        key = joined["source"] + "\0" + joined["code"]
        whole = int((key != key.iloc[-1]).sum())
        if whole:
            yield joined.iloc[:whole]
        rest = joined.iloc[whole:].reset_index(drop=True)
        if len(rest) >= LONG_SOURCE:
            part = rest["day"].iloc[-OVERLAP]
            first = int((rest["day"] < part).sum())
            # a day of more readings than that is waited for until it has passed
            if first > OVERLAP:
                piece = rest.copy()
                piece.loc[len(piece) - 1, "high"] = part
                yield piece
                rest = rest.iloc[first - OVERLAP :].reset_index(drop=True)
                rest.loc[0, "low"] = part
        held, rows = [rest], len(rest)
    if rows:
        yield pd.concat(held, ignore_index=True)


def regularize(readings: DataFrame, source: str, sec: str, value: str, code: str, prefer: str) -> DataFrame:
    """One row per source and period between its first and last reading.

    sec: epoch second; code: D, W, M or Q per source; prefer: of several readings of one instant
    the one greatest by this column counts (nulls lowest, then the greater value), and of the instants of a period
    likewise for its reading; the smoother sees all instants. Returns
    source, period_start (date), reading (null if missing), missing, smoothed, std_error and
    filled (the reading, else the smoothed value). Rows with null source, time or code, and
    null, NaN or infinite values are no readings. Empty input gives no rows.
    """
    r = readings.filter(f"{source} IS NOT NULL AND {sec} IS NOT NULL AND {code} IS NOT NULL AND {value} IS NOT NULL AND NOT isnan({value}) AND abs({value}) < double('infinity')")
    r = r.select(F.col(source).cast("string").alias("source"), F.col(code).alias("code"), F.col(sec).cast("double").alias("sec"), F.col(value).cast("double").alias("value"), F.col(prefer).cast("string").alias("prefer"))
    r = r.groupBy("source", "code", "sec").agg(F.max(F.struct("prefer", "value")).alias("b"))
    r = r.select("source", "code", period_day(F.col("sec"), F.col("code")).alias("day"), "sec", "b.prefer", "b.value")
    ordered = r.repartition("source", "code").sortWithinPartitions("source", "code", "sec")
    schema = "source string, period_start date, reading double, missing boolean, smoothed double, std_error double"
    grid = ordered.mapInPandas(lambda batches: (fill_sources(pdf) for pdf in _whole_sources(batches)), schema)
    grid = grid.withColumn("reading", F.nullif("reading", F.lit(float("nan"))))
    return grid.withColumn("filled", F.coalesce("reading", "smoothed")).withColumnRenamed("source", source)
