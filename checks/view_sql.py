"""The stand-in views as DuckDB SQL, and their use as common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

NUMBER = r"^\s*\+?(\d+\.?\d*|\.\d+)([eE]\+?\d+)?\s*$"


def number(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '{NUMBER}') THEN TRY_CAST(trim({text}) AS DOUBLE) END"


def _pieces(text: str) -> tuple[str, str]:
    one = f"split_part({text}, '%', 1)"
    low = f"CASE WHEN contains({text}, '-') THEN {number(f'''replace(split_part({text}, '-', 1), '%', '')''')} ELSE {number(one)} END"
    high = f"CASE WHEN contains({text}, '-') THEN {number(f'''replace(split_part({text}, '-', 2), '%', '')''')} ELSE {number(one)} END"
    return low, high


def range_ends(text: str) -> tuple[str, str]:
    low, high = _pieces(text)
    return (
        f"CASE WHEN ({high}) IS NOT NULL THEN {low} END",
        f"CASE WHEN ({low}) IS NOT NULL THEN {high} END",
    )


def percent_ends(text: str) -> tuple[str, str]:
    return tuple(
        f"CASE WHEN ({end}) IS NOT NULL THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, {end})) END"
        for end in range_ends(text)
    )


def depth_ends(text: str) -> tuple[str, str]:
    plain = f"regexp_replace(lower({text}), '[+<>]', '', 'g')"
    found = f"regexp_extract_all({plain}, '([\\d.]+)', 1)"
    feet = [
        f"CASE WHEN len({found}) IN (1, 2) THEN TRY_CAST({found}[1] AS DOUBLE) * 0.3048::DOUBLE END",
        f"CASE WHEN len({found}) IN (1, 2) THEN TRY_CAST({found}[len({found})] AS DOUBLE) * 0.3048::DOUBLE END",
    ]
    metres = range_ends(f"replace(replace({plain}, 'm', ''), 'ð', '-')")
    return tuple(
        f"CASE WHEN contains({plain}, 'ft') THEN {f} ELSE {m} END" for f, m in zip(feet, metres)
    )


_B, _D, _M = percent_ends("percent_bleached"), depth_ends("depth"), percent_ends("percent_mortality")
_CLEAN_COLUMNS = f"""
  {_B[0]} AS min_percent_bleached, {_B[1]} AS max_percent_bleached,
  {_M[0]} AS min_percent_mortality, {_M[1]} AS max_percent_mortality,
  {_D[0]} AS min_depth, {_D[1]} AS max_depth
"""
_LAT = "(-20.0::DOUBLE + 0.5::DOUBLE * ({c} // 5))"
_LON = "(140.0::DOUBLE + 0.5::DOUBLE * ({c} % 5))"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "grid_daily": (
        (),
        f"""SELECT s_nationkey AS cell, {_LAT.format(c='s_nationkey')} AS latitude, {_LON.format(c='s_nationkey')} AS longitude,
          l_shipdate AS time, year(l_shipdate)::INT AS year, 20.0::DOUBLE + avg(l_quantity) / 5.0::DOUBLE AS sst
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_shipdate""",
    ),
    "grid_gaps": (
        ("grid_daily",),
        "SELECT * REPLACE (CASE WHEN (day(time) + cell) % 29 <> 0 THEN sst END AS sst) FROM grid_daily",
    ),
    "grid_sources": (
        (),
        f"""SELECT l_shipdate AS time, {_LAT.format(c='s_nationkey')} AS latitude, {_LON.format(c='s_nationkey')} AS longitude,
          l_suppkey AS source_order, 20.0::DOUBLE + avg(l_quantity) / 5.0::DOUBLE AS sst
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_shipdate, l_suppkey""",
    ),
    "grid_sparse": (
        (),
        "SELECT user_id AS cell, date_trunc('day', ts)::TIMESTAMP AS time, avg(value) AS sst FROM events GROUP BY 1, 2",
    ),
    "observations": (
        (),
        f"""SELECT o_orderkey AS obs_id, year(o_orderdate)::INT AS year,
          CASE WHEN o_orderkey % 97 <> 0 THEN month(o_orderdate)::INT END AS month,
          CASE WHEN o_orderkey % 89 <> 0 THEN {_LAT.format(c='c_nationkey')} + 0.05::DOUBLE * (o_orderkey % 9 - 4) END AS latitude,
          {_LON.format(c='c_nationkey')} + 0.05::DOUBLE * ((o_orderkey // 9) % 9 - 4) AS longitude,
          CASE o_orderkey % 6 WHEN 0 THEN concat(x, '-', x + 10, '%') WHEN 1 THEN concat(x, '%') WHEN 2 THEN concat(x)
            WHEN 3 THEN concat('  ', x, '-', x + 5, ' ') WHEN 5 THEN concat('-', x) END AS percent_bleached,
          CASE o_custkey % 7 WHEN 0 THEN concat(n, 'm') WHEN 1 THEN concat(n, ' ft') WHEN 2 THEN concat(n, '-', n + 5, 'ft')
            WHEN 3 THEN concat('>', n) WHEN 4 THEN concat(n, '-', n + 5) WHEN 5 THEN concat('<', n, ' m') END AS depth,
          CASE o_custkey % 5 WHEN 0 THEN concat(x // 2, '%') WHEN 1 THEN concat(x // 2, '-', x // 2 + 5, '%')
            WHEN 2 THEN 'abc' WHEN 4 THEN concat(x // 2) END AS percent_mortality
        FROM (SELECT *, floor(o_totalprice / 5000)::BIGINT AS x, o_orderkey % 40 + 1 AS n FROM orders)
          JOIN customer ON o_custkey = c_custkey""",
    ),
    "cleaned": (
        ("observations",),
        f"""SELECT obs_id, year, month, latitude, longitude, percent_bleached, (min_depth + max_depth) / 2.0::DOUBLE AS depth,
          percent_mortality, make_date(year, 1, 1) AS date, min_percent_bleached, max_percent_bleached,
          (min_percent_bleached + max_percent_bleached) / 2.0::DOUBLE AS mean_percent_bleached,
          min_percent_mortality, max_percent_mortality,
          (min_percent_mortality + max_percent_mortality) / 2.0::DOUBLE AS mean_percent_mortality,
          min_depth, max_depth
        FROM (SELECT *, {_CLEAN_COLUMNS} FROM observations)""",
    ),
    "dated": (
        ("cleaned",),
        """SELECT obs_id, year, month, latitude, longitude, make_date(year, month, 1) AS date,
          min_percent_bleached, mean_percent_bleached
        FROM cleaned WHERE month IS NOT NULL AND latitude IS NOT NULL""",
    ),
    "sites": (
        (),
        f"""SELECT c_nationkey AS site,
          round({_LAT.format(c='c_nationkey')} + avg(0.05::DOUBLE * (o_orderkey % 9 - 4)), 4) AS latitude,
          round({_LON.format(c='c_nationkey')} + avg(0.05::DOUBLE * ((o_orderkey // 9) % 9 - 4)), 4) AS longitude
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""",
    ),
    "monthly": (
        ("grid_daily",),
        """SELECT cell, last_day(time) AS month_end, avg(sst) AS sst, year(last_day(time))::INT AS year,
          month(last_day(time))::INT AS month FROM grid_daily GROUP BY cell, last_day(time)""",
    ),
    "lines": (
        ("monthly",),
        """SELECT cell, month, regr_slope(sst, year) AS slope, regr_intercept(sst, year) AS intercept,
          regr_intercept(sst, year) + regr_slope(sst, year) * 1997.0::DOUBLE AS prediction
        FROM monthly GROUP BY cell, month""",
    ),
    "static": (
        ("lines",),
        """SELECT cell, max(mmm) AS mmm, max(CASE WHEN prediction = mmm THEN month END)::INT AS month_of_mmm
        FROM (SELECT *, max(prediction) OVER (PARTITION BY cell) AS mmm FROM lines) GROUP BY cell""",
    ),
    "static_located": (
        ("static",),
        f"SELECT {_LAT.format(c='cell')} AS latitude, {_LON.format(c='cell')} AS longitude, mmm, month_of_mmm FROM static",
    ),
    "hot": (
        ("grid_daily", "static"),
        """SELECT g.*, mmm, CASE WHEN sst - mmm > 0 THEN sst - mmm ELSE 0.0::DOUBLE END AS hotspot,
          CASE WHEN sst - mmm >= 1 THEN sst - mmm END AS strong
        FROM grid_daily g JOIN static USING (cell)""",
    ),
    "catalogue": (
        ("grid_daily",),
        """SELECT concat(patch, '/SST_', strftime(first, '%Y-%m-%d'), '_', strftime(last_day(first), '%Y-%m-%d'), '.nc') AS path,
          'SST' AS var, patch, year(first)::INT AS year, first AS start, last_day(first) AS "end",
          CASE WHEN month(first) % 7 = 0 THEN 0 ELSE n * 8 END::BIGINT AS bytes
        FROM (SELECT printf('patch_%.0f_%.0f_%.0f_%.0f', floor(latitude), floor(latitude) + 1, floor(longitude), floor(longitude) + 1) AS patch,
            date_trunc('month', time)::DATE AS first, count(*) AS n FROM grid_daily GROUP BY 1, 2)
        WHERE month(first) % 5 <> 0""",
    ),
    "boxes_by_year": (
        ("observations",),
        """SELECT year, min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max
        FROM observations WHERE latitude IS NOT NULL GROUP BY year""",
    ),
    "tiles": (
        ("boxes_by_year",),
        """SELECT DISTINCT printf('patch_%.0f_%.0f_%.0f_%.0f', lat0, lat0 + 1, lon0, lon0 + 1) AS patch,
          lat0, lat0 + 1 AS lat1, lon0, lon0 + 1 AS lon1
        FROM (SELECT *, unnest(generate_series(floor(lat_min)::INT, ceil(lat_max)::INT - 1))::DOUBLE AS lat0 FROM boxes_by_year),
          LATERAL (SELECT unnest(generate_series(floor(lon_min)::INT, ceil(lon_max)::INT - 1))::DOUBLE AS lon0)""",
    ),
    "regions": (
        ("grid_daily",),
        """SELECT ['gbr', 'enso3', 'waus', 'pg', 'unnamed'][band + 1] AS region, (i - 1)::INT AS seq,
          [y0, y0, y1 - 0.05::DOUBLE, y1, y1][i] AS lats, [x0, x1, x1, x1 - 0.05::DOUBLE, x0][i] AS lons
        FROM (SELECT floor((latitude + 20.0) / 0.5)::INT AS band, latitude - 0.1::DOUBLE AS y0,
            latitude + CASE WHEN floor((latitude + 20.0) / 0.5) = 1 THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END AS y1,
            min(longitude) - 0.1::DOUBLE AS x0, max(longitude) + 0.1::DOUBLE AS x1
          FROM grid_daily GROUP BY latitude), (SELECT unnest([1, 2, 3, 4, 5]) AS i)""",
    ),
    "points": (
        ("observations",),
        "SELECT obs_id, latitude, longitude FROM observations WHERE latitude IS NOT NULL",
    ),
    "edges": (
        ("regions",),
        """SELECT region AS polygon_id, seq, lons AS x1, lats AS y1,
          coalesce(lead(lons) OVER w, first_value(lons) OVER w) AS x2,
          coalesce(lead(lats) OVER w, first_value(lats) OVER w) AS y2
        FROM regions WINDOW w AS (PARTITION BY region ORDER BY seq)""",
    ),
    "held": (
        ("points", "edges"),
        """SELECT obs_id, latitude, longitude, polygon_id FROM points, edges GROUP BY ALL
        HAVING sum(CASE WHEN (y1 <= latitude) <> (y2 <= latitude)
              AND x1 + (latitude - y1) * (x2 - x1) / (y2 - y1) < longitude THEN 1 ELSE 0 END) % 2 = 1
          OR bool_or((longitude - x1) * (y2 - y1) - (latitude - y1) * (x2 - x1) = 0
              AND longitude BETWEEN least(x1, x2) AND greatest(x1, x2)
              AND latitude BETWEEN least(y1, y2) AND greatest(y1, y2))""",
    ),
    "scored": (
        (),
        """SELECT doc_id, model, label, score, (score >= 0.5)::INT AS prediction FROM (
          SELECT doc_id, unnest(['a', 'b']) AS model, unnest([quality, toxic]) AS label,
            round(n_chars / (n_chars + 2000.0::DOUBLE), 2) AS score
          FROM labels JOIN documents USING (doc_id))""",
    ),
    "ranked": (
        ("scored",),
        """SELECT model, score, pos, neg,
          sum(pos) OVER (PARTITION BY model ORDER BY score DESC)::BIGINT AS tp,
          sum(neg) OVER (PARTITION BY model ORDER BY score DESC)::BIGINT AS fp,
          sum(pos) OVER (PARTITION BY model)::BIGINT AS p, sum(neg) OVER (PARTITION BY model)::BIGINT AS n
        FROM (SELECT model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg
          FROM scored GROUP BY model, score)""",
    ),
}
# Nearest cell of each observation with a place: the axes are the grid's distinct coordinates.
VIEWS["placed"] = (
    ("observations", "grid_daily"),
    """SELECT o.*, la.a AS _lat, lo.a AS _lon FROM observations o
      JOIN (SELECT v, a FROM (SELECT v, a, row_number() OVER (PARTITION BY v ORDER BY abs(a - v), a) AS k
        FROM (SELECT DISTINCT latitude AS v FROM observations WHERE latitude IS NOT NULL), (SELECT DISTINCT latitude AS a FROM grid_daily)) WHERE k = 1) la
        ON la.v = o.latitude
      JOIN (SELECT v, a FROM (SELECT v, a, row_number() OVER (PARTITION BY v ORDER BY abs(a - v), a) AS k
        FROM (SELECT DISTINCT longitude AS v FROM observations), (SELECT DISTINCT longitude AS a FROM grid_daily)) WHERE k = 1) lo
        ON lo.v = o.longitude""",
)
VIEWS["series"] = (
    ("dated", "placed", "grid_daily"),
    """SELECT d.obs_id, d.date, g.time, g.sst FROM dated d JOIN placed p USING (obs_id)
      JOIN grid_daily g ON g.latitude = p._lat AND g.longitude = p._lon
        AND g.time BETWEEN d.date - INTERVAL 31 DAY AND d.date""",
)


def _needed(names: Sequence[str], found: list[str]) -> list[str]:
    for name in names:
        if name not in found:
            _needed(VIEWS[name][0], found)
            found.append(name)
    return found


def with_views(sql: str, views: Sequence[str]) -> str:
    """``sql`` with the views it needs in front; a leading WITH is continued."""
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in _needed(views, [])]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"
