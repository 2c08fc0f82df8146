"""Readings of written times as Catalyst expressions: no Python runs per row.

`time_candidates` lists every valid reading of a text as (format, epoch second); the
mixture model of operators.timestamps weighs them, `parse_instant` takes the plausible one.
All arithmetic is on epoch seconds, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their offsets from UTC in minutes.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "JST": 540, "AEST": 600, "AEDT": 660,
}
# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MONTH = r"((?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?))\.?"
_WEEKDAY = r"(?i:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_OFFSET = r"[+-]\d{2}(?::?\d{2})?"

#: Shape of each written form: pattern with date parts and the rest, and which group is year, month, day, rest.
SHAPES = {
    "iso": (r"^(\d{4})-(\d{2})-(\d{2})((?:[T ].*)?)$", (1, 2, 3, 4)),
    "year_slash": (r"^(\d{4})/(\d{1,2})/(\d{1,2})((?:[T ].*)?)$", (1, 2, 3, 4)),
    "compact": (r"^(\d{4})(\d{2})(\d{2})((?:T.*)?)$", (1, 2, 3, 4)),
    "slash": (r"^(\d{1,2})/(\d{1,2})/(\d{4})((?:[T ,].*)?)$", (3, 1, 2, 4)),
    "dot": (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})((?:[T ,].*)?)$", (3, 2, 1, 4)),
    "day_month_name": (rf"^{_WEEKDAY}(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}})((?:[T ,].*)?)$", (3, 2, 1, 4)),
    "month_name_day": (rf"^{_WEEKDAY}{_MONTH} (\d{{1,2}}),? (\d{{4}})((?:[T ,].*)?)$", (3, 1, 2, 4)),
}
EPOCH_UNITS = {"epoch_s": 1, "epoch_ms": 10**3, "epoch_us": 10**6, "epoch_ns": 10**9}
#: The plain form of a time, read at fixed places.
PLAIN = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?$"
#: Readings outside these years are not valid ones; in text, 9999 is a filler.
YEARS = (1600, 2200)


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: A region zone as the time zone database names it; unknown ones fail to parse and give null.
_REGION = r"^[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+$"


def _instant(date: str, p: str) -> str:
    """Epoch second of the date text at the parsed time of day and zone, or null."""
    local = f"(unix_date(try_cast({date} AS DATE)) * 86400L + {p}clock)"
    text = f"concat({date}, ' ', lpad({p}clock div 3600, 2, '0'), ':', lpad({p}clock div 60 % 60, 2, '0'), ':', lpad({p}clock % 60, 2, '0'), ' ', {p}z)"
    return f"CASE WHEN {p}offset IS NOT NULL THEN {local} - {p}offset * 60 WHEN {p}z RLIKE {_q(_REGION)} THEN unix_seconds(try_to_timestamp({text}, 'yyyy-MM-dd HH:mm:ss VV')) END"


def time_candidates(df: DataFrame, text: Column, zone: Column, out: str, slash_orders: tuple[str, ...] = ("month_first",)) -> DataFrame:
    """Add `out`: array<struct<fmt, sec>> of every valid reading of `text`.

    zone: the zone of a time of day written without one; a bare date is 00:00 UTC whatever
    the zone. slash_orders: which of month_first and day_first a date with slashes may mean.
    Null, empty, filler (0, -1, year 9999) and impossible times give an empty array. A local
    hour that occurs twice means the earlier instant, a skipped one takes the offset that held
    before the change. An unknown zone makes a time without a written zone unreadable.
    """
    p = f"__{out}_"
    kinds = list(SHAPES.items())
    shape = " ".join(f"WHEN {p}t RLIKE {_q(rx)} THEN {_q(k)}" for k, (rx, _) in kinds)
    # the frequent shapes have their parts at fixed places, the others take the pattern again
    fixed = {"iso": ("1, 4", "6, 2", "9, 2", "11"), "compact": ("1, 4", "5, 2", "7, 2", "9")}
    take = lambda k, rx, g, i: f"substr({p}t, {fixed[k][i]})" if k in fixed else f"regexp_extract({p}t, {_q(rx)}, {g[i]})"
    part = lambda i: f"CASE {p}k " + " ".join(f"WHEN {_q(k)} THEN {take(k, rx, g, i)}" for k, (rx, g) in kinds) + " END"
    names = "array(" + ", ".join(map(_q, MONTHS)) + ")"
    clock = rf"^[T ,]*\s*(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,]\d{{1,9}})?)?\s*(?:([AaPp][Mm])(?![A-Za-z]))?\s*({_OFFSET}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)*)?$"
    grab = lambda i: f"IF({p}r = '', '', regexp_extract({p}r, {_q(clock)}, {i}))"
    hour = f"CASE WHEN {p}ap = '' THEN {p}h WHEN {p}h BETWEEN 1 AND 12 THEN {p}h % 12 + IF({p}ap = 'pm', 12, 0) END"
    abbr = "map(" + ", ".join(f"{_q(k)}, {v}" for k, v in ZONE_MINUTES.items()) + ")"
    signed = f"IF(substr({p}z, 1, 1) = '-', -1, 1) * (cast(substr({p}z, 2, 2) AS INT) * 60 + IF(length({p}z) > 3, cast(right({p}z, 2) AS INT), 0))"
    day = f"concat_ws('-', {p}y, {p}mo, {p}d)"
    first = f"{p}k IS NOT NULL" + ("" if "month_first" in slash_orders else f" AND {p}k != 'slash'")
    readings = [f"struct({p}k AS fmt, IF({first}, {_instant(day, p)}, NULL) AS sec)"]
    if "day_first" in slash_orders:
        swapped = f"concat_ws('-', {p}y, {p}d, {p}mo)"
        readings.append(f"struct('slash_day_first' AS fmt, IF({p}k = 'slash', {_instant(swapped, p)}, NULL) AS sec)")
    readings += [f"struct({_q(k)} AS fmt, IF({p}n > 0, {p}n div {per}L, NULL) AS sec)" for k, per in EPOCH_UNITS.items()]
    low, high = ((y - 1970) * 31556952 for y in YEARS)
    kept = df.columns
    df = _stage(df.drop(out), {f"{p}w": F.trim(text.cast("string")), f"{p}zone": zone})
    # most times are plain, and numbers other than dates have one reading for each unit: both skip the patterns
    two = lambda i: f"cast(substr({p}w, {i}, 2) AS INT)"
    clock_z = f"IF(length({p}w) = 10, 0, IF({two(12)} <= 23 AND {two(15)} <= 59 AND {two(18)} <= 59, {two(12)} * 3600 + {two(15)} * 60 + {two(18)}, NULL))"
    df = _stage(df, {f"{p}plain": F.expr(f"IF({p}w RLIKE {_q(PLAIN)}, unix_date(try_cast(substr({p}w, 1, 10) AS DATE)) * 86400L + {clock_z}, NULL)"), f"{p}n": F.expr(f"IF({p}w RLIKE '^[0-9]{{8,19}}$', try_cast({p}w AS BIGINT), NULL)")})
    df = _stage(df, {f"{p}t": F.expr(f"IF({p}plain IS NOT NULL OR ({p}n IS NOT NULL AND length({p}w) != 8), NULL, {p}w)")})
    df = _stage(df, {f"{p}k": F.expr(f"CASE WHEN {p}t IS NOT NULL THEN CASE {shape} END END")})
    df = _stage(df, {f"{p}y": F.expr(part(0)), f"{p}mraw": F.expr(part(1)), f"{p}d": F.expr(f"lpad({part(2)}, 2, '0')"), f"{p}rest": F.expr(part(3))})
    # T153000 is the compact form of T15:30:00
    df = _stage(
        df,
        {
            f"{p}mo": F.expr(f"lpad(IF({p}mraw RLIKE '^[0-9]+$', {p}mraw, cast(array_position({names}, lower(substr({p}mraw, 1, 3))) AS STRING)), 2, '0')"),
            f"{p}r": F.expr(f"CASE WHEN {p}rest RLIKE '^T[0-9]{{6}}' THEN concat(substr({p}rest, 1, 3), ':', substr({p}rest, 4, 2), ':', substr({p}rest, 6)) WHEN {p}rest RLIKE '^T[0-9]{{4}}' THEN concat(substr({p}rest, 1, 3), ':', substr({p}rest, 4)) ELSE {p}rest END"),
        },
    )
    df = _stage(df, {f"{p}h": F.expr(f"try_cast({grab(1)} AS INT)"), f"{p}m": F.expr(f"try_cast({grab(2)} AS INT)"), f"{p}s": F.expr(f"coalesce(try_cast({grab(3)} AS INT), 0)"), f"{p}ap": F.expr(f"lower({grab(4)})"), f"{p}zraw": F.expr(grab(5))})
    df = _stage(
        df,
        {
            f"{p}clock": F.expr(f"CASE WHEN {p}r = '' THEN 0 WHEN ({hour}) <= 23 AND {p}m <= 59 AND {p}s <= 59 THEN ({hour}) * 3600 + {p}m * 60 + {p}s END"),
            f"{p}z": F.expr(f"CASE WHEN {p}r = '' THEN 'UTC' WHEN {p}zraw = '' THEN {p}zone ELSE {p}zraw END"),
        },
    )
    df = _stage(df, {f"{p}offset": F.expr(f"CASE WHEN {p}z RLIKE '^[+-][0-9]{{2}}' THEN IF(abs({signed}) <= 1080, {signed}, NULL) ELSE try_element_at({abbr}, upper({p}z)) END")})
    valid = f"filter(array({', '.join(readings)}), x -> x.sec BETWEEN {low} AND {high} AND (NOT x.fmt LIKE 'epoch%' OR x.sec >= 86400))"
    df = _stage(df, {out: F.expr(f"IF({p}plain BETWEEN {low} AND {high}, array(struct('iso' AS fmt, {p}plain AS sec)), {valid})")})
    return df.select(*[F.col(f"`{c}`") for c in kept if c != out], out)


def _stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a Generate, which the optimizer does not fold into its neighbours.

    Plain projections would be merged, and a filter on the last result would repeat the whole
    chain of expressions at each use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def parse_instant(df: DataFrame, text: Column, zone: Column, out: str) -> DataFrame:
    """Add `out`: the epoch second of `text` under the stated conventions, or null.

    A number is read in the unit that puts it into 1980 to 2100.
    """
    df = time_candidates(df, text, zone, f"{out}__c")
    plausible = "between 315532800 and 4102444800"
    return _stage(df, {out: F.expr(f"coalesce(try_element_at(filter({out}__c, x -> NOT x.fmt LIKE 'epoch%'), 1).sec, try_element_at(filter({out}__c, x -> x.sec {plausible}), 1).sec)")}).drop(f"{out}__c")


def utc_text(sec: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ of an epoch second."""
    day = F.floor(sec / F.lit(86400)).cast("int")
    rest = F.pmod(sec, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), two(rest / 3600), F.lit(":"), two(F.pmod(rest / 60, F.lit(60))), F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit("Z"))
