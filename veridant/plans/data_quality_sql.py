"""SQL counterparts of the data quality queries, written apart from the operators.

Times are read with strptime formats and a time zone database instead of the patterns of
functions.timeparse, orphans with as-of joins, requests with a ranked join.
"""

from __future__ import annotations

# Strptime forms of dates and local times.
_FORMS = [
    "%Y-%m-%d", "%Y%m%d", "%m/%d/%Y", "%d.%m.%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y",
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y%m%dT%H%M%S", "%m/%d/%Y %I:%M:%S %p", "%d %b %Y %H:%M:%S", "%d %B %Y %H:%M:%S",
]


def _instants(name: str, source: str) -> str:
    """CTEs ending in `name`: the rows of `source` (columns t, z and more) with u, the UTC timestamp of t."""
    forms = ", ".join(f"'{f}'" for f in _FORMS)
    return f"""{name}_0 AS ({source}),
    {name}_1 AS (SELECT *, regexp_extract(t, '(Z| GMT| EST| EDT| [A-Z][a-z]+/[A-Za-z_]+|:[0-9]{{2}}[+-][0-9]{{2}}:?[0-9]{{2}})$', 1) zn0 FROM {name}_0),
    {name}_2 AS (SELECT *, CASE WHEN zn0 LIKE ':%' THEN substr(zn0, 4) ELSE zn0 END zn FROM {name}_1),
    {name}_3 AS (SELECT *, regexp_replace(left(t, length(t) - length(zn)), '^[A-Z][a-z]{{2}}, ', '') b0 FROM {name}_2),
    {name}_4 AS (SELECT *, CASE WHEN contains(b0, ':') THEN regexp_replace(b0, '[.][0-9]+$', '') ELSE b0 END b FROM {name}_3),
    {name}_5 AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]{{9,}}$') THEN NULL ELSE try_strptime(b, [{forms}]) END l, NOT contains(b, ':') AND NOT contains(b, 'T') bare, CASE WHEN zn LIKE ' %/%' THEN trim(zn) ELSE z END zz FROM {name}_4),
    {name}_6 AS (SELECT *, CASE WHEN l IS NOT NULL AND zz LIKE '%/%' THEN timezone(zz, l) END tz FROM {name}_5),
    {name} AS (SELECT * EXCLUDE (zn0, zn, b0, b, l, bare, zz, tz), CASE WHEN year(l) > 2200 OR year(l) < 1600 THEN NULL WHEN l IS NOT NULL AND (bare OR zn IN ('Z', ' GMT') OR (zn = '' AND z = 'UTC')) THEN l
      WHEN zn = ' EST' THEN l + INTERVAL 5 hour WHEN zn = ' EDT' THEN l + INTERVAL 4 hour
      WHEN zn LIKE '+%' OR zn LIKE '-%' THEN l - (CASE WHEN zn LIKE '-%' THEN -1 ELSE 1 END * (substr(zn, 2, 2)::int * 60 + right(zn, 2)::int)) * INTERVAL 1 minute
      WHEN tz IS NOT NULL THEN timezone('UTC', CASE WHEN timezone(zz, tz - INTERVAL 1 hour) = l THEN tz - INTERVAL 1 hour ELSE tz END)
      WHEN regexp_matches(t, '^[0-9]{{10}}$') THEN make_timestamp(t::bigint * 1000000) WHEN regexp_matches(t, '^[0-9]{{13}}$') THEN make_timestamp(t::bigint * 1000)
      WHEN regexp_matches(t, '^[0-9]{{16}}$') THEN make_timestamp(t::bigint) WHEN regexp_matches(t, '^[0-9]{{19}}$') THEN make_timestamp(t::bigint // 1000) END u FROM {name}_6)"""


_FREQUENCY = "CASE WHEN regexp_matches(lower(trim(frequency)), '^(business )?d') THEN 'D' WHEN lower(trim(frequency)) LIKE 'w%' THEN 'W' WHEN lower(trim(frequency)) LIKE 'm%' THEN 'M' WHEN lower(trim(frequency)) LIKE 'q%' THEN 'Q' END"
_PERIOD = "CASE c WHEN 'D' THEN u::date - greatest(isodow(u) - 5, 0)::int WHEN 'W' THEN date_trunc('week', u)::date WHEN 'M' THEN date_trunc('month', u)::date ELSE date_trunc('quarter', u)::date END"
_KEY = "nullif(lower(regexp_replace({c}, '^[ \\t]+|[ \\t]+$', '', 'g')), '')"
_REFS = f"""loc AS (SELECT {_KEY.format(c="object_id")} k, loaded_at t, coalesce(lower(trim(quality_status)) IN ('deleted', 'tombstoned', 'removed'), false) gone FROM global_object_locator),
    e AS (SELECT edge_id, loaded_at t, from_object_id f, to_object_id o, period FROM global_edge_spine QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at) = 1),
    p AS (SELECT series_key || '@' || period rk, loaded_at t, object_id o, period FROM chart_series_points QUALIFY row_number() OVER (PARTITION BY series_key, period ORDER BY loaded_at) = 1),
    refs AS (SELECT 'global_edge_spine' table_name, edge_id record_key, 'from_object_id' ref_column, {_KEY.format(c="f")} k, t, period FROM e UNION ALL SELECT 'global_edge_spine', edge_id, 'to_object_id', {_KEY.format(c="o")}, t, period FROM e UNION ALL SELECT 'chart_series_points', rk, 'object_id', {_KEY.format(c="o")}, t, period FROM p),
    f AS (SELECT k, min(t) first_t FROM loc GROUP BY 1), st AS (SELECT k, t, bool_and(gone) gone FROM loc GROUP BY 1, 2),
    j AS (SELECT r.*, first_t, st.gone FROM (SELECT * FROM refs WHERE k IS NOT NULL) r LEFT JOIN f ON f.k = r.k ASOF LEFT JOIN st ON r.k = st.k AND r.t >= st.t),
    orphans AS (SELECT *, CASE WHEN first_t IS NULL THEN 'missing' WHEN first_t > t THEN 'late' WHEN gone THEN 'deleted' END kind FROM j)"""
# Powers of ten of unit spellings, by pattern in order.
_POWER = """CASE WHEN {x} IS NULL OR trim({x}) = '' THEN NULL WHEN regexp_matches({x}, '(?i)bps|basis point') THEN -2 WHEN regexp_matches({x}, '(?i)fraction|ratio') THEN 2 WHEN regexp_matches({x}, '(?i)percent|pct|%') THEN 0
    WHEN {x} LIKE '%kWh%' THEN -3 WHEN {x} LIKE '%MWh%' THEN 0 WHEN {x} LIKE '%GWh%' THEN 3 WHEN {x} LIKE '%TWh%' THEN 6 WHEN regexp_matches({x}, '(?i)billion|bn') OR {x} LIKE '%B' THEN 9 WHEN regexp_matches({x}, '(?i)crore') THEN 7
    WHEN regexp_matches({x}, '(?i)million|mm|mn') OR {x} LIKE '%M' OR {x} LIKE '% m' OR {x} LIKE '%M shares' THEN 6 WHEN regexp_matches({x}, '(?i)lakh') THEN 5 WHEN regexp_matches({x}, '(?i)thousand|000s') OR {x} LIKE '%k' OR {x} LIKE '%(k)' OR {x} LIKE '%k employees' THEN 3 ELSE 0 END"""

# Pieces of the SQL of doubtful readings, by source k and period i.
def _trim(source: str, name: str) -> str:
    """Changes without those beyond six median absolute deviations; with a deviation of zero, that of the changes that move."""
    return f"""{name}_c AS (SELECT k, median(x) c FROM {source} GROUP BY 1), {name}_m AS (SELECT k, any_value(c) c, 1.4826 * median(abs(x - c)) m, median(abs(x - c)) FILTER (x <> c) z FROM {source} JOIN {name}_c USING (k) GROUP BY 1),
    {name} AS (SELECT k, x FROM {source} JOIN {name}_m USING (k) WHERE coalesce(nullif(m, 0), z, 0) = 0 OR abs(x - c) <= 6.0 * coalesce(nullif(m, 0), z))"""


def _band(source: str, name: str) -> str:
    """Rolling medians before and after, the middle of both and the deviation from it."""
    near = "count({x}) OVER {w} >= 2"
    scaled = lambda x: f"CASE WHEN kind = 'volume' THEN ln(greatest({x}, 1e-9)) ELSE {x} END"
    return f"""{name}_a AS (SELECT *, CASE WHEN {near.format(x="v", w="wb")} THEN median(v) OVER wb END bf, CASE WHEN {near.format(x="v", w="wa")} THEN median(v) OVER wa END af FROM {source} WINDOW wb AS (PARTITION BY k ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), wa AS (PARTITION BY k ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
    {name}_b AS (SELECT *, CASE WHEN bf IS NOT NULL AND af IS NOT NULL THEN ({scaled("bf")} + {scaled("af")}) / 2 WHEN bf IS NOT NULL THEN {scaled("bf")} WHEN af IS NOT NULL THEN {scaled("af")} END mid FROM {name}_a), {name}_c AS (SELECT *, CASE WHEN v IS NOT NULL THEN abs({scaled("v")} - mid) END f FROM {name}_b),
    {name} AS (SELECT *, 1.4826 * least(coalesce(median(f) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 1e300), coalesce(median(f) OVER (PARTITION BY k), 0)) sp FROM {name}_c)"""


_LEAVES = "CASE kind WHEN 'price' THEN abs(v - {at}) > 0.3 * abs({at}) WHEN 'volume' THEN v > 20.0 * {at} OR v * 20.0 < {at} ELSE ch > 0 AND abs(v - {at}) > 10.0 * ch END"
_OUT = f"coalesce(abs(CASE WHEN kind = 'volume' THEN ln(greatest(v, 1e-9)) ELSE v END - mid) > 3.0 * sp AND {_LEAVES.format(at='bf')} AND {_LEAVES.format(at='af')}, false)"


def _short(source: str, name: str) -> str:
    """Rows with `short`: flagged in a run of at most two."""
    return f"{name}_g AS (SELECT *, i - row_number() OVER (PARTITION BY k, o ORDER BY i) g FROM {source}), {name} AS (SELECT *, o AND count(*) OVER (PARTITION BY k, o, g) <= 2 short FROM {name}_g)"


ORACLE_SQL: dict[str, str] = {
    "p2_found": f"""WITH c AS (SELECT series_key, max({_FREQUENCY}) c FROM series_catalog GROUP BY 1), {_instants("o", "SELECT series_key, c, phenomenon_time t, 'UTC' z FROM observations JOIN c USING (series_key) WHERE value IS NOT NULL AND c IS NOT NULL")},
    r AS (SELECT DISTINCT series_key, c, {_PERIOD} AS d FROM o WHERE u IS NOT NULL), b AS (SELECT series_key, c, min(d) a, max(d) z FROM r GROUP BY 1, 2),
    g AS (SELECT series_key, c, unnest(generate_series(a::timestamp, z::timestamp, CASE c WHEN 'D' THEN INTERVAL 1 day WHEN 'W' THEN INTERVAL 7 day WHEN 'M' THEN INTERVAL 1 month ELSE INTERVAL 3 month END))::date AS d FROM b)
    SELECT series_key, strftime(d, '%Y-%m-%d') period_start FROM g WHERE (c <> 'D' OR isodow(d) <= 5) AND NOT EXISTS (SELECT 1 FROM r WHERE r.series_key = g.series_key AND r.d = g.d)""",
    "p3_found": f"""WITH p AS (SELECT * FROM chart_series_points QUALIFY row_number() OVER (PARTITION BY series_key, period ORDER BY loaded_at DESC) = 1), s AS (SELECT series_key, max(unit) unit FROM chart_series GROUP BY 1),
    x AS (SELECT series_key, period, value, unit, replace(regexp_extract(formatted_value, '[0-9][0-9,]*([.][0-9]+)?([eE][+-]?[0-9]+)?'), ',', '') n, regexp_replace(formatted_value, '[0-9][0-9,]*([.][0-9]+)?([eE][+-]?[0-9]+)?', '') w FROM p LEFT JOIN s USING (series_key) WHERE value IS NOT NULL),
    y AS (SELECT *, {_POWER.format(x="w")} pw, {_POWER.format(x="unit")} pu FROM x)
    SELECT series_key, period, e AS exp10 FROM (SELECT series_key, period, CASE WHEN pw IS NOT NULL AND n::double > 0 AND value <> 0 THEN round(log10(n::double * power(10, pw) / abs(value)))::int ELSE pu END e FROM y) WHERE e <> 0""",
    "p4_found": f"""WITH {_instants("o", "SELECT observation_id, series_key, phenomenon_time t, 'UTC' z, result_time, regexp_replace(vintage, '^([0-9]{4})([0-9]{2})([0-9]{2})$', '\\1-\\2-\\3') v FROM observations WHERE value IS NOT NULL")},
    k AS (SELECT observation_id, series_key, u, v, CASE WHEN result_time IS NOT NULL THEN timezone('UTC', try_cast(CASE WHEN length(result_time) = 10 THEN result_time || ' 00:00:00+00' ELSE result_time END AS TIMESTAMPTZ)) ELSE try_cast(nullif(v, '') AS TIMESTAMP) END kn FROM o WHERE u IS NOT NULL)
    SELECT request_id, observation_id FROM (SELECT request_id, observation_id, row_number() OVER (PARTITION BY request_id ORDER BY u DESC, kn DESC, try_cast(v AS DATE) DESC NULLS LAST, observation_id DESC) rn FROM (SELECT DISTINCT request_id, series_key, requested_at FROM context_requests) q JOIN k USING (series_key) WHERE u <= requested_at AND kn <= requested_at) WHERE rn = 1""",
    "p5_found": f"WITH {_REFS} SELECT table_name, record_key, ref_column, kind FROM orphans WHERE kind IS NOT NULL",
    "p5_report": f'WITH {_REFS} SELECT table_name, period, ref_column, kind, count(*) "references", count(DISTINCT k) keys FROM orphans WHERE kind IS NOT NULL GROUP BY ALL',
    "p6_found": f"""WITH {_instants("x", "SELECT 'fmp_price' table_name, record_id::varchar record_id, date t, exchange_tz z FROM fmp_price UNION ALL SELECT 'fred_cpi', record_id::varchar, realtime_start, 'America/New_York' FROM fred_cpi UNION ALL SELECT 'observations', observation_id, phenomenon_time, 'UTC' FROM observations UNION ALL SELECT 'polygon_daily', record_id::varchar, t::varchar, 'UTC' FROM polygon_daily")}
    SELECT DISTINCT table_name, record_id, strftime(u, '%Y-%m-%dT%H:%M:%SZ') utc_time FROM x WHERE u IS NOT NULL AND NOT CASE WHEN table_name = 'polygon_daily' THEN length(t) = 13 ELSE regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z)?$') END""",
    "p2_checks": f"""WITH c AS (SELECT series_key, max({_FREQUENCY}) c FROM series_catalog GROUP BY 1), {_instants("o", "SELECT series_key, c, phenomenon_time t, 'UTC' z FROM observations JOIN c USING (series_key) WHERE value IS NOT NULL AND c IS NOT NULL")},
    r AS (SELECT DISTINCT series_key, c, {_PERIOD} AS d FROM o WHERE u IS NOT NULL), b AS (SELECT series_key, c, min(d) a, max(d) z FROM r GROUP BY 1, 2),
    g AS (SELECT series_key, c, unnest(generate_series(a::timestamp, z::timestamp, CASE c WHEN 'D' THEN INTERVAL 1 day WHEN 'W' THEN INTERVAL 7 day WHEN 'M' THEN INTERVAL 1 month ELSE INTERVAL 3 month END))::date AS d FROM b)
    SELECT g.series_key, count(*) periods, count(*) FILTER (r.d IS NULL) missing, true sound FROM g LEFT JOIN r ON r.series_key = g.series_key AND r.d = g.d WHERE g.c <> 'D' OR isodow(g.d) <= 5 GROUP BY 1""",
    "p3_evidence": """WITH p AS (SELECT * FROM chart_series_points QUALIFY row_number() OVER (PARTITION BY series_key, period ORDER BY loaded_at DESC) = 1), s AS (SELECT series_key, max(unit) unit FROM chart_series GROUP BY 1),
    x AS (SELECT series_key, period, value, unit, formatted_value fv, replace(regexp_extract(formatted_value, '[0-9][0-9,]*([.][0-9]+)?([eE][+-]?[0-9]+)?'), ',', '') n, regexp_replace(formatted_value, '[0-9][0-9,]*([.][0-9]+)?([eE][+-]?[0-9]+)?', '') w FROM p LEFT JOIN s USING (series_key) WHERE value IS NOT NULL),
    y AS (SELECT *, __PW__ pw, __PU__ pu FROM x), e AS (SELECT *, pw IS NOT NULL AND n::double > 0 AND value <> 0 AS t, CASE WHEN pw IS NOT NULL AND n::double > 0 AND value <> 0 THEN round(log10(n::double * power(10, pw) / abs(value)))::int ELSE pu END e FROM y)
    SELECT CASE WHEN t THEN 'text' ELSE 'unit' END unit_evidence, CASE WHEN len(list_filter(regexp_extract_all(lower(CASE WHEN t THEN w ELSE unit END), '[a-z]+'), lambda a: a NOT IN ('usd', 'eur', 'inr', 'jpy', 'us', 'k', 'm', 'mm', 'b', 's', 'in', 'kwh', 'mwh', 'gwh', 'twh'))) > 0 THEN 'index' ELSE 'sign' END found_by, count(*) points FROM e WHERE e <> 0 GROUP BY 1, 2""".replace("__PW__", _POWER.format(x="w")).replace("__PU__", _POWER.format(x="unit")),
    "p6_evidence": f"""WITH {_instants("x", "SELECT DISTINCT 'fmp_price' table_name, record_id::varchar record_id, date t, exchange_tz z FROM fmp_price UNION SELECT DISTINCT 'fred_cpi', record_id::varchar, realtime_start, 'America/New_York' FROM fred_cpi UNION SELECT DISTINCT 'observations', observation_id, phenomenon_time, 'UTC' FROM observations UNION SELECT DISTINCT 'polygon_daily', record_id::varchar, t::varchar, 'UTC' FROM polygon_daily")}
    SELECT table_name, CASE WHEN (regexp_matches(t, '^[0-9]{{1,2}}/[0-9]{{1,2}}/') AND split_part(t, '/', 1)::int <= 12 AND split_part(t, '/', 2)::int <= 12 AND split_part(t, '/', 1)::int <> split_part(t, '/', 2)::int) OR regexp_matches(t, '^([0-9]{{8}}|[0-9]{{10}}|[0-9]{{13}}|[0-9]{{16}})$') THEN 'mixture' ELSE 'single' END decided_by, count(*) times, 0 unresolved FROM x WHERE u IS NOT NULL GROUP BY 1, 2""",
    "p5_current": f"""WITH {_REFS}, rc AS (SELECT k, count(*) reference_count FROM refs WHERE k IS NOT NULL GROUP BY 1), la AS (SELECT k, bool_and(gone) gone FROM loc WHERE k IS NOT NULL AND t = (SELECT max(l2.t) FROM loc l2 WHERE l2.k = loc.k) GROUP BY 1)
    SELECT rc.k AS key, reference_count, 0 existence_count FROM rc LEFT JOIN la USING (k) WHERE coalesce(gone, true)""",
    "p1_found": f"""WITH c AS (SELECT series_key, max({_FREQUENCY}) c, max(canonical_metric) metric, max(unit) unit FROM series_catalog WHERE series_key IS NOT NULL GROUP BY 1),
    {_instants("o", "SELECT observation_id, o.series_key, coalesce(c.c, 'D') c, metric, unit, phenomenon_time t, 'UTC' z, value FROM observations o LEFT JOIN c USING (series_key) WHERE value IS NOT NULL")}, {_instants("h", "SELECT observation_id, ticker, 'D' c, trade_date t, 'UTC' z, close, volume FROM ohlcv_observations")},
    r AS (SELECT 'observations' table_name, observation_id, 'value' field_name, series_key source, {_PERIOD} AS d, value v, CASE WHEN metric LIKE '%price%' OR series_key LIKE 'price_close:%' THEN 'price' WHEN metric = 'policy_rate' THEN 'rate_steps'
        WHEN metric LIKE '%index%' OR metric LIKE '%starts%' OR metric LIKE '%claims%' OR metric LIKE '%unemployment%' OR unit IN ('index', 'persons', 'thousand units') THEN 'count' ELSE 'level' END kind FROM o WHERE u IS NOT NULL
      UNION ALL SELECT 'ohlcv_observations', observation_id, 'close', ticker, {_PERIOD}, close, 'price' FROM h WHERE u IS NOT NULL AND close IS NOT NULL UNION ALL SELECT 'ohlcv_observations', observation_id, 'volume', ticker, {_PERIOD}, volume, 'volume' FROM h WHERE u IS NOT NULL AND volume IS NOT NULL),
    k AS (SELECT *, concat_ws(chr(1), table_name, field_name, coalesce(source, '')) k FROM r WHERE NOT isnan(v) AND abs(v) < 'infinity'::double), ce AS (SELECT DISTINCT k, d, v, kind FROM k),
    p0 AS (SELECT *, round(abs(v), 2) a FROM ce), p1 AS (SELECT *, floor(a) w, round(a - floor(a), 2) f, CASE WHEN floor(a) > 0 THEN floor(log10(greatest(floor(a), 1))) + 1 ELSE 0 END g FROM p0),
    b AS (SELECT k, d, v, kind, (w = power(10, g) - 1 AND f IN (0.0, 0.9, 0.99) AND (g >= 6 OR (v < 0 AND g >= 3))) OR (kind = 'price' AND v <= 0) OR (kind IN ('volume', 'count') AND v < 0) bad FROM p1),
    l AS (SELECT k, any_value(kind) kind, d, median(v) v FROM b WHERE NOT bad GROUP BY k, d), li AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) i FROM l),
    d0 AS (SELECT k, v - lag(v) OVER (PARTITION BY k ORDER BY i) x FROM li), e0 AS (SELECT k, x FROM d0 WHERE x IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k) >= 3),
    {_trim("e0", "e1")}, {_trim("e1", "e2")}, {_trim("e2", "e3")}, ch AS (SELECT k, sqrt(avg(x * x)) ch FROM e3 GROUP BY 1),
    s1 AS (SELECT li.*, coalesce(ch, 0) ch FROM li LEFT JOIN ch USING (k)), {_band("s1", "q1")}, ou AS (SELECT k, i, d, kind, ch, v, {_OUT} o FROM q1), {_short("ou", "os")}, s2 AS (SELECT k, i, d, kind, ch, CASE WHEN short THEN NULL ELSE v END v FROM os), {_band("s2", "q2")},
    ju AS (SELECT b.k, b.d, b.v, q2.i, q2.kind, q2.ch, q2.bf, q2.af, q2.mid, q2.sp FROM b JOIN q2 ON b.k = q2.k AND b.d = q2.d WHERE NOT bad), jo AS (SELECT *, {_OUT} o FROM ju), bp AS (SELECT k, i, bool_or(o) o FROM jo GROUP BY 1, 2), {_short("bp", "bs")}, sp AS (SELECT jo.k, jo.d, jo.v FROM jo JOIN bs USING (k, i) WHERE jo.o AND bs.short),
    pe AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) n FROM (SELECT DISTINCT k, d FROM b)), t0 AS (SELECT b.k, b.d, b.v, n, n - row_number() OVER (PARTITION BY b.k, b.v ORDER BY n) grp FROM b JOIN pe ON pe.k = b.k AND pe.d = b.d WHERE NOT bad AND kind <> 'rate_steps'),
    t1 AS (SELECT *, count(*) OVER (PARTITION BY k, v, grp) len, row_number() OVER (PARTITION BY k, v, grp ORDER BY n) pos FROM t0), t2 AS (SELECT k, count(DISTINCT n) FILTER (pos > 1) still, sum(len - 1) FILTER (pos = 1 AND len >= 6) ins FROM t1 GROUP BY 1), t3 AS (SELECT k, max(n) - 1 moves FROM pe GROUP BY 1),
    st AS (SELECT t1.k, t1.d, t1.v FROM t1 JOIN t2 USING (k) JOIN t3 USING (k) WHERE len >= 6 AND pos > 1 AND moves - coalesce(ins, 0) > 0 AND still - coalesce(ins, 0) <= 0.5 * (moves - coalesce(ins, 0))),
    al AS (SELECT k, d, v FROM b WHERE bad UNION SELECT k, d, v FROM sp UNION SELECT k, d, v FROM st) SELECT DISTINCT table_name, observation_id, field_name FROM k JOIN al USING (k, d, v)""",
}

#: The readings of p1_found by reason; impossible before spike before stuck.
ORACLE_SQL["p1_evidence"] = (
    ORACLE_SQL["p1_found"].split("al AS (SELECT k, d, v FROM b WHERE bad")[0]
    + """al AS (SELECT k, d, v, 'impossible' reason FROM b WHERE bad UNION ALL SELECT k, d, v, 'spike' FROM sp UNION ALL SELECT k, d, v, 'stuck' FROM st WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.k = st.k AND sp.d = st.d AND sp.v = st.v))
    SELECT table_name, field_name, reason, count(DISTINCT observation_id) readings FROM k JOIN al USING (k, d, v) GROUP BY 1, 2, 3"""
)
