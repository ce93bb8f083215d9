"""The whole hourly flow and its intermediate grid."""

from ..flagship import SIGNALS, filled_hours, hourly_features
from ..registry import query

_RAW = ", ".join(f"avg(CASE WHEN signal = '{s}' AND value <> -1 THEN value END) AS {s}_mean, count(CASE WHEN signal = '{s}' AND value <> -1 THEN value END) AS {s}_count" for s in SIGNALS)
_NB = ", ".join(f"""last_value({s}_mean IGNORE NULLS) OVER w AS {s}_lv, last_value(CASE WHEN {s}_mean IS NOT NULL THEN i END IGNORE NULLS) OVER w AS {s}_li,
 first_value({s}_mean IGNORE NULLS) OVER z AS {s}_rv, first_value(CASE WHEN {s}_mean IS NOT NULL THEN i END IGNORE NULLS) OVER z AS {s}_ri""" for s in SIGNALS)
_FILL = ", ".join(f"""coalesce({s}_mean, CASE WHEN {s}_ri - {s}_li - 1 <= 12 AND abs(({s}_rv - {s}_lv) / ({s}_ri - {s}_li)) <= 30 AND {s}_lv + ({s}_rv - {s}_lv) / ({s}_ri - {s}_li) BETWEEN 0 AND 200
 AND {s}_lv + ({s}_rv - {s}_lv) * (i - {s}_li) / ({s}_ri - {s}_li) BETWEEN 0 AND 200 THEN {s}_lv + ({s}_rv - {s}_lv) * (i - {s}_li) / ({s}_ri - {s}_li) END) AS {s}_mean""" for s in SIGNALS)
FLOW = f"""h AS (SELECT entity, date_trunc('hour', ts)::TIMESTAMP AS hour, {_RAW}, count(*) AS total_records FROM readings_n GROUP BY ALL),
e AS (SELECT entity, min(hour) AS a, max(hour) AS b FROM h GROUP BY entity), g AS (SELECT entity, a, b, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM e),
d AS (SELECT g.*, h.* EXCLUDE (entity, hour), row_number() OVER (PARTITION BY g.entity ORDER BY g.hour) AS i FROM g LEFT JOIN h ON g.entity = h.entity AND g.hour = h.hour),
nb AS (SELECT *, {_NB} FROM d WINDOW w AS (PARTITION BY entity ORDER BY i ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY entity ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT entity, a, b, hour, total_records, {_FILL} FROM nb)"""
_R = " ".join(f"{s}_mean" for s in SIGNALS)


@query("I-01,I-14,G-01", "flow_filled_hours", views="readings_n", r=_R, i="total_records",
       sql=f"WITH {FLOW} SELECT entity, hour, total_records, {', '.join(f'{s}_mean' for s in SIGNALS)} FROM f")
def _(v):
    return filled_hours(v).select("entity", "hour", "total_records", *[f"{s}_mean" for s in SIGNALS])


_STATS = ", ".join(f"count({s}_mean) AS {s}_count, avg({s}_mean) AS {s}_mean, stddev({s}_mean) AS {s}_std, min({s}_mean) AS {s}_min, max({s}_mean) AS {s}_max" for s in SIGNALS)


@query("G-01,I-01,I-14,J-01,W-01,G-09,G-03,D-37", "flow_window_features", views="readings_n price", digits=5,
       r=" ".join(f"{s}_{st}" for s in SIGNALS for st in ("mean", "std", "min", "max")) + " coverage cost peak_ratio",
       i="window_no records " + " ".join(f"{s}_count" for s in SIGNALS),
       sql=f"""WITH {FLOW}, p AS (SELECT f.*, price FROM f LEFT JOIN price USING (hour)),
       wn AS (SELECT entity, a, unnest(generate_series(0, (epoch(b) - epoch(a) - 86400)::BIGINT // 21600)) AS window_no FROM e WHERE epoch(b) - epoch(a) >= 86400),
       x AS (SELECT wn.window_no, wn.a + wn.window_no * INTERVAL 6 HOUR AS window_start, p.* FROM wn JOIN p ON p.entity = wn.entity AND p.hour >= wn.a + wn.window_no * INTERVAL 6 HOUR AND p.hour < wn.a + wn.window_no * INTERVAL 6 HOUR + INTERVAL 24 HOUR)
       SELECT entity, window_no, window_start, coalesce(sum(total_records), 0) AS records, {_STATS}, ({' + '.join(f'count({s}_mean)' for s in SIGNALS)}) / {24 * len(SIGNALS)} AS coverage, sum(view_mean * price) AS cost,
       CASE WHEN sum(CASE WHEN hour(hour) NOT BETWEEN 7 AND 22 THEN view_mean END) > 0 THEN coalesce(sum(CASE WHEN hour(hour) BETWEEN 7 AND 22 THEN view_mean END), 0) / sum(CASE WHEN hour(hour) NOT BETWEEN 7 AND 22 THEN view_mean END) END AS peak_ratio
       FROM x GROUP BY entity, window_no, window_start HAVING ({' + '.join(f'count({s}_mean)' for s in SIGNALS)}) > 0""")
def _(v):
    return hourly_features(v)
