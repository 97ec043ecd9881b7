"""The same frames as DuckDB SQL, written independently of the operators.

Each entry is a named query over the given tables. ``compose`` prefixes a statement with the
entries it needs.
"""

from __future__ import annotations

import re

from checks.bindings import END, EVENTS, FIRST_YEAR, FOLDS, GAPPY_END, GAPPY_START, LAST_YEAR, START
from tidecast.operators.events import GUIDANCE

Z95 = "1.959963984540054"


def r(expression: str, digits: int) -> str:
    """Rounded double without a negative zero."""
    return f"(CASE WHEN round({expression}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expression}, {digits})::DOUBLE END)"


def _first_weekday(month: int, weekday: int, n: int) -> str:
    first = f"make_date(y, {month}, 1)"
    return f"({first} + ((({weekday} - dayofweek({first}) + 7) % 7) + {7 * (n - 1)})::INTEGER)"


def _holiday_sql() -> str:
    full_moon = "((225 - 11 * (y % 19) - 21) % 30 + 21)"
    d = f"({full_moon} - (CASE WHEN {full_moon} > 48 THEN 1 ELSE 0 END))"
    q = f"({d} + 7 - ((y + y // 4 + {d} + 1) % 7))"
    last_of_may = "make_date(y, 5, 31)"
    thursday = _first_weekday(11, 4, 4)
    rules = [
        ("New Year''s Day", 1, "make_date(y, 1, 1)"),
        ("Martin Luther King Jr. Day", 0, _first_weekday(1, 1, 3)),
        ("Super Bowl Sunday", 1, _first_weekday(2, 0, 2)),
        ("Valentine''s Day", 0, "make_date(y, 2, 14)"),
        ("Presidents Day", 0, _first_weekday(2, 1, 3)),
        ("Easter Sunday", 1, f"(make_date(y, 3, 1) + ({q} - 1)::INTEGER)"),
        ("Mother''s Day", 1, _first_weekday(5, 0, 2)),
        ("Memorial Day", 1, f"({last_of_may} - ((dayofweek({last_of_may}) + 6) % 7)::INTEGER)"),
        ("Father''s Day", 1, _first_weekday(6, 0, 3)),
        ("Juneteenth", 0, "make_date(y, 6, 19)"),
        ("Independence Day", 1, "make_date(y, 7, 4)"),
        ("Labor Day", 1, _first_weekday(9, 1, 1)),
        ("Columbus Day", 0, _first_weekday(10, 1, 2)),
        ("Halloween", 1, "make_date(y, 10, 31)"),
        ("Veterans Day", 0, "make_date(y, 11, 11)"),
        ("Thanksgiving Day", 1, thursday),
        ("Black Friday", 1, f"({thursday} + 1)"),
        ("Cyber Monday", 1, f"({thursday} + 4)"),
        ("Christmas Eve", 1, "make_date(y, 12, 24)"),
        ("Christmas Day", 1, "make_date(y, 12, 25)"),
        ("New Year''s Eve", 1, "make_date(y, 12, 31)"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT {day}::DATE AS d, {i} AS o, '{name}' AS n, {bool(major)} AS m FROM yrs"
        for i, (name, major, day) in enumerate(rules)
    )
    return f"""
        WITH yrs AS (SELECT unnest(range({FIRST_YEAR}, {LAST_YEAR + 1}))::BIGINT AS y), every AS ({rows})
        SELECT d AS holiday_date, arg_max(n, o) AS holiday_name, arg_max(m, o) AS is_major
        FROM every GROUP BY d"""


def _hourly(table: str, hour: str, desktop: str, title: str, views: str) -> str:
    return f"""SELECT {hour} AS datehour, CASE WHEN {desktop} THEN 'en' ELSE 'en.m' END AS wiki,
        {title} AS title, {views} AS views FROM {table}"""


def _raw(hourly: str) -> str:
    return f"""SELECT CAST(datehour AS DATE) AS date, title AS ad_unit, 'en' AS wiki,
        CAST(sum(views) AS BIGINT) AS daily_impressions,
        CAST(coalesce(sum(views) FILTER (WHERE wiki = 'en'), 0) AS BIGINT) AS desktop_impressions,
        CAST(coalesce(sum(views) FILTER (WHERE wiki = 'en.m'), 0) AS BIGINT) AS mobile_impressions
        FROM {hourly} GROUP BY ALL"""


def featured(source: str, columns: str) -> str:
    """``columns`` of ``source`` (which holds ``date``) with calendar and holiday columns."""
    return f"""SELECT {columns}, dayofweek(s.date) + 1 AS day_of_week, dayofweek(s.date) IN (0, 6) AS is_weekend,
        quarter(s.date) AS quarter, CAST(strftime(s.date, '%U') AS BIGINT) AS week_of_year,
        h.holiday_date IS NOT NULL AS is_holiday, h.holiday_name,
        CAST(nx.nearest - s.date AS BIGINT) AS days_to_next_holiday
        FROM {source} s LEFT JOIN x_hol h ON h.holiday_date = s.date
        LEFT JOIN (SELECT u.date, min(k.holiday_date) AS nearest
                   FROM (SELECT DISTINCT date FROM {source}) u JOIN x_hol k ON k.holiday_date >= u.date
                   GROUP BY u.date) nx ON nx.date = s.date"""


_VOLUMES = "s.date, s.ad_unit, s.daily_impressions, s.desktop_impressions, s.mobile_impressions"


def _fills(source: str, start, end) -> str:
    around = []
    for c in ("daily_impressions", "desktop_impressions", "mobile_impressions"):
        around.append(f"""last_value({c} IGNORE NULLS) OVER (PARTITION BY ad_unit ORDER BY date
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_{c[0:2]},
            first_value({c} IGNORE NULLS) OVER (PARTITION BY ad_unit ORDER BY date
            ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n_{c[0:2]}""")
    return f"""
        WITH grid AS (SELECT CAST(g.d AS DATE) AS date, u.ad_unit
                FROM generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY) g(d),
                     (SELECT DISTINCT ad_unit FROM {source}) u),
             seen AS (SELECT grid.date, grid.ad_unit, e.date IS NULL AS missing, e.daily_impressions,
                e.desktop_impressions, e.mobile_impressions
                FROM grid LEFT JOIN {source} e ON e.date = grid.date AND e.ad_unit = grid.ad_unit),
             looked AS (SELECT *, {', '.join(around)} FROM seen)
        SELECT date, ad_unit, CAST(round((p_da + n_da) / 2.0) AS BIGINT) AS daily_impressions,
            CAST(round((p_de + n_de) / 2.0) AS BIGINT) AS desktop_impressions,
            CAST(round((p_mo + n_mo) / 2.0) AS BIGINT) AS mobile_impressions
        FROM looked WHERE missing AND p_da IS NOT NULL AND n_da IS NOT NULL"""


def _values(rows, names: str) -> str:
    quoted = ["(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows]
    return f"SELECT * FROM (VALUES {', '.join(quoted)}) v({names})"


def zero_shot(train: str) -> str:
    return f"""
        WITH aged AS (SELECT *, row_number() OVER (PARTITION BY fold_name, ad_unit, dayofweek(date) ORDER BY date DESC) AS age,
                 daily_impressions - lag(daily_impressions, 7) OVER (PARTITION BY fold_name, ad_unit ORDER BY date) AS diff
                 FROM {train}),
             lv AS (SELECT fold_name, ad_unit, dayofweek(date) AS dw, avg(daily_impressions) AS v FROM aged
                 WHERE age <= 4 GROUP BY ALL),
             sg AS (SELECT fold_name, ad_unit, max(date) AS last_date, stddev_samp(diff) AS s,
                 avg(daily_impressions) AS overall FROM aged GROUP BY ALL),
             st AS (SELECT sg.*, h, last_date + h::INTEGER AS fd FROM sg, range(1, 93) q(h)),
             jn AS (SELECT st.*, coalesce(lv.v, overall) AS v FROM st LEFT JOIN lv ON lv.fold_name = st.fold_name
                 AND lv.ad_unit = st.ad_unit AND lv.dw = dayofweek(st.fd))
        SELECT fd AS forecast_date, ad_unit, 'seasonal_zero_shot' AS model_name, fold_name, v AS forecast_value,
            v - {Z95} * s * sqrt(1 + (h - 1) // 7) AS forecast_lower,
            v + {Z95} * s * sqrt(1 + (h - 1) // 7) AS forecast_upper FROM jn"""


def _regressors(train: str) -> str:
    return f"""SELECT fold_name, ad_unit, date, daily_impressions::DOUBLE AS y, day_of_week::DOUBLE AS x1,
                 is_weekend::INT::DOUBLE AS x2, is_holiday::INT::DOUBLE AS x3,
                 coalesce(days_to_next_holiday, 0)::DOUBLE AS x4 FROM {train}"""


def regression_fit(train: str) -> str:
    return least_squares(_regressors(train))


def least_squares(rows: str) -> str:
    """Least squares by making each regressor uncorrelated with the ones before it."""
    w = "OVER (PARTITION BY fold_name, ad_unit)"
    return f"""
        WITH q0 AS ({rows}),
             q1 AS (SELECT *, regr_slope(x2, x1) {w} AS b21 FROM q0),
             q2 AS (SELECT *, x2 - b21 * x1 AS z2 FROM q1),
             q3 AS (SELECT *, regr_slope(x3, x1) {w} AS b31, regr_slope(x3, z2) {w} AS b32 FROM q2),
             q4 AS (SELECT *, x3 - b31 * x1 - b32 * z2 AS z3 FROM q3),
             q5 AS (SELECT *, regr_slope(x4, x1) {w} AS b41, regr_slope(x4, z2) {w} AS b42, regr_slope(x4, z3) {w} AS b43 FROM q4),
             q6 AS (SELECT *, x4 - b41 * x1 - b42 * z2 - b43 * z3 AS z4 FROM q5),
             q7 AS (SELECT *, regr_slope(y, x1) {w} AS g1, regr_slope(y, z2) {w} AS g2, regr_slope(y, z3) {w} AS g3,
                 regr_slope(y, z4) {w} AS g4 FROM q6),
             q8 AS (SELECT *, y - g1 * x1 - g2 * z2 - g3 * z3 - g4 * z4 AS part FROM q7),
             q9 AS (SELECT fold_name, ad_unit, max(date) AS last_date, count(*) AS n, avg(part) AS intercept,
                 sqrt(var_pop(part) * count(*) / (count(*) - 5)) AS sigma, any_value(b21) AS b21, any_value(b31) AS b31,
                 any_value(b32) AS b32, any_value(g1 - g4 * b41) AS h1, any_value(g2 - g4 * b42) AS h2,
                 any_value(g3 - g4 * b43) AS h3, any_value(g4) AS c4 FROM q8 GROUP BY ALL)
        SELECT fold_name, ad_unit, last_date, n, intercept, sigma, h1 - h3 * b31 - (h2 - h3 * b32) * b21 AS c1,
            h2 - h3 * b32 AS c2, h3 AS c3, c4 FROM q9"""


AR_ROUNDS = 8
_X = [f"x{k}" for k in range(1, 5)]
_C = [f"c{k}" for k in range(1, 5)]


def regression_ar(train: str) -> dict[str, str]:
    """Least squares of quasi-differences and the slope of its residuals in turn, as one named query a step."""
    lags = ", ".join(f"lag({c}) OVER (PARTITION BY fold_name, ad_unit ORDER BY date) AS l{c}" for c in ["y", *_X])
    out = {"x_ar_rows": f"SELECT *, {lags} FROM ({_regressors(train)})"}
    for step in range(AR_ROUNDS + 1):
        phi = "0.0" if step == 0 else "p.phi"
        source = "x_ar_rows q" if step == 0 else f"x_ar_rows q JOIN x_ar_phi{step} p ON p.fold_name = q.fold_name AND p.ad_unit = q.ad_unit"
        differences = ", ".join(f"{c} - {phi} * l{c} AS {c}" for c in ["y", *_X])
        out[f"x_ar_flat{step}"] = least_squares(f"SELECT q.fold_name, q.ad_unit, q.date, {differences} FROM {source} WHERE ly IS NOT NULL")
        if step == 0:
            out["x_ar_fit0"] = "SELECT *, 0.0::DOUBLE AS phi FROM x_ar_flat0"
        else:
            out[f"x_ar_fit{step}"] = f"""SELECT b.* REPLACE (b.intercept / (1 - p.phi) AS intercept), p.phi FROM x_ar_flat{step} b
                JOIN x_ar_phi{step} p ON p.fold_name = b.fold_name AND p.ad_unit = b.ad_unit"""
        e = "q.y - b.intercept - " + " - ".join(f"b.{c} * q.{x}" for c, x in zip(_C, _X))
        e1 = "q.ly - b.intercept - " + " - ".join(f"b.{c} * q.l{x}" for c, x in zip(_C, _X))
        out[f"x_ar_phi{step + 1}"] = f"""SELECT q.fold_name, q.ad_unit, greatest(-0.98, least(0.98, sum(({e}) * ({e1})) / sum(({e1}) * ({e1})))) AS phi
            FROM x_ar_rows q JOIN x_ar_fit{step} b ON b.fold_name = q.fold_name AND b.ad_unit = q.ad_unit WHERE q.ly IS NOT NULL GROUP BY ALL"""
    out["x_ar"] = f"""SELECT b.* REPLACE (b.n + 1 AS n), {e} AS last_e FROM x_ar_fit{AR_ROUNDS} b
        JOIN x_ar_rows q ON q.fold_name = b.fold_name AND q.ad_unit = b.ad_unit AND q.date = b.last_date"""
    return out


def regression_forecast(fit: str, features: str) -> str:
    return f"""
        WITH v AS (SELECT f.date, f.ad_unit, f.fold_name, p.sigma, p.intercept + p.c1 * f.day_of_week
                 + p.c2 * f.is_weekend::INT + p.c3 * f.is_holiday::INT + p.c4 * coalesce(f.days_to_next_holiday, 0) AS v
                 FROM {features} f JOIN {fit} p ON p.fold_name = f.fold_name AND p.ad_unit = f.ad_unit
                 WHERE f.date > p.last_date)
        SELECT date AS forecast_date, ad_unit, 'structural_xreg' AS model_name, fold_name, v AS forecast_value,
            v - {Z95} * sigma AS forecast_lower, v + {Z95} * sigma AS forecast_upper FROM v"""


def _structural(prefix: str, train: str) -> dict[str, str]:
    """The decomposition model as a chain of named steps."""
    p = prefix
    one = "PARTITION BY fold_name, ad_unit"
    rows = f"{one} ORDER BY date ROWS BETWEEN"
    return {
        f"{p}_rows": f"""SELECT fold_name, ad_unit, date, holiday_name, daily_impressions::DOUBLE AS y,
            min(date) OVER ({one}) AS t0, date - min(date) OVER ({one}) AS t FROM {train}""",
        f"{p}_near": f"""SELECT *, count(y) OVER w AS k, avg(y) OVER w AS m, stddev_samp(y) OVER w AS s FROM {p}_rows
            WINDOW w AS ({rows} 14 PRECEDING AND 14 FOLLOWING EXCLUDE CURRENT ROW)""",
        f"{p}_clean": f"""SELECT *, CASE WHEN k < 7 THEN y WHEN y > m + 3 * s THEN m + 3 * s
            WHEN y < m - 3 * s THEN m - 3 * s ELSE y END AS c FROM {p}_near""",
        f"{p}_sides": f"""SELECT *, CASE WHEN count(c) OVER b = 30 THEN avg(c) OVER b END AS lo,
            CASE WHEN count(c) OVER a = 30 THEN avg(c) OVER a END AS hi FROM {p}_clean
            WINDOW b AS ({rows} 30 PRECEDING AND 1 PRECEDING), a AS ({rows} 1 FOLLOWING AND 30 FOLLOWING)""",
        f"{p}_score": f"""SELECT *, CASE WHEN lo > 0 AND hi > 0 AND round(greatest(hi / lo, lo / hi), 2) >= 2
            THEN round(round(least(greatest(hi / lo, lo / hi), 1e6), 2) * 100)::BIGINT * 1000000 - t END AS sc FROM {p}_sides""",
        f"{p}_step": f"""SELECT *, CASE WHEN sc = max(sc) OVER ({rows} 30 PRECEDING AND 30 FOLLOWING)
            THEN hi - lo ELSE 0 END AS step FROM {p}_score""",
        f"{p}_level": f"""SELECT *, sum(step) OVER ({rows} UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM {p}_step""",
        f"{p}_line": f"""SELECT fold_name, ad_unit, coalesce(regr_slope(c - level, t), 0) AS slope,
            coalesce(regr_intercept(c - level, t), avg(c - level)) AS icpt, max(date) AS last_date, count(*) AS n_days,
            max(t) + 1 AS span FROM {p}_level GROUP BY ALL""",
        f"{p}_flat": f"""SELECT l.*, slope, icpt, last_date, span, c - level - icpt - slope * t AS f
            FROM {p}_level l JOIN {p}_line USING (fold_name, ad_unit)""",
        f"{p}_week": f"""SELECT a.fold_name, a.ad_unit, dw, a.v - b.v AS weekly FROM
            (SELECT fold_name, ad_unit, dayofweek(date) AS dw, avg(f) AS v FROM {p}_flat GROUP BY ALL) a JOIN
            (SELECT fold_name, ad_unit, avg(f) AS v FROM {p}_flat GROUP BY ALL) b USING (fold_name, ad_unit)""",
        f"{p}_unw": f"""SELECT x.*, weekly, f - weekly AS u FROM {p}_flat x JOIN {p}_week k ON k.fold_name = x.fold_name
            AND k.ad_unit = x.ad_unit AND k.dw = dayofweek(x.date)""",
        f"{p}_year": f"""SELECT fold_name, ad_unit, month(date) AS mo, avg(u) AS yearly FROM {p}_unw WHERE span >= 365 GROUP BY ALL""",
        f"{p}_uny": f"""SELECT x.*, yearly, u - coalesce(yearly, 0) AS q FROM {p}_unw x LEFT JOIN {p}_year k
            ON k.fold_name = x.fold_name AND k.ad_unit = x.ad_unit AND k.mo = month(x.date)""",
        f"{p}_hol": f"""SELECT fold_name, ad_unit, holiday_name, avg(q) AS heff FROM {p}_uny WHERE holiday_name IS NOT NULL GROUP BY ALL""",
        f"{p}_rest": f"""SELECT x.*, heff, q - coalesce(heff, 0) AS e FROM {p}_uny x LEFT JOIN {p}_hol k
            ON k.fold_name = x.fold_name AND k.ad_unit = x.ad_unit AND k.holiday_name = x.holiday_name""",
        f"{p}_lag": f"""SELECT *, lag(e, 1) OVER w AS e1, e - lag(e, 1) OVER w AS de, lag(e, 1) OVER w - lag(e, 2) OVER w AS de1
            FROM {p}_rest WINDOW w AS ({one} ORDER BY date)""",
        f"{p}_ar": f"""SELECT fold_name, ad_unit, count(*) AS n, avg(e) AS me, avg(e1) AS me1, avg(de) AS md, avg(de1) AS md1,
            least(greatest(coalesce(regr_slope(e, e1), 0), -0.98), 0.98) AS pe,
            least(greatest(coalesce(regr_slope(de, de1), 0), -0.98), 0.98) AS pd,
            abs(avg(de)) > 1.96 * sqrt(var_pop(de) / count(*)) AS drifts
            FROM {p}_lag WHERE de1 IS NOT NULL GROUP BY ALL""",
        f"{p}_sse": f"""SELECT fold_name, ad_unit, any_value(n) AS n, any_value(me) AS me, any_value(me1) AS me1,
            any_value(md) AS md, any_value(md1) AS md1, any_value(pe) AS pe, any_value(pd) AS pd, any_value(drifts) AS drifts,
            greatest(avg((e - me) ** 2), 1e-9) AS v00, greatest(avg((e - me - pe * (e1 - me1)) ** 2), 1e-9) AS v10,
            greatest(avg((de - CASE WHEN drifts THEN md ELSE 0 END) ** 2), 1e-9) AS v01,
            greatest(avg((de - pd * de1 - CASE WHEN drifts THEN md - pd * md1 ELSE 0 END) ** 2), 1e-9) AS v11
            FROM {p}_lag JOIN {p}_ar USING (fold_name, ad_unit) WHERE de1 IS NOT NULL GROUP BY fold_name, ad_unit""",
        f"{p}_aic": f"""SELECT *, round(n * ln(v00) + 2, 6) AS a00, round(n * ln(v01) + 2, 6) AS a01,
            round(n * ln(v10) + 4, 6) AS a10, round(n * ln(v11) + 4, 6) AS a11 FROM {p}_sse""",
        f"{p}_pick": f"""SELECT *, CASE least(a00, a01, a10, a11) WHEN a00 THEN '00' WHEN a01 THEN '01' WHEN a10 THEN '10'
            ELSE '11' END AS ord FROM {p}_aic""",
        f"{p}_par": f"""SELECT fold_name, ad_unit, n, left(ord, 1)::BIGINT AS p, right(ord, 1)::BIGINT AS d,
            CASE ord WHEN '10' THEN pe WHEN '11' THEN pd ELSE 0.0 END AS phi,
            CASE ord WHEN '00' THEN me WHEN '10' THEN (me - pe * me1) / (1 - pe)
                WHEN '01' THEN CASE WHEN drifts THEN md ELSE 0 END
                ELSE CASE WHEN drifts THEN (md - pd * md1) / (1 - pd) ELSE 0 END END AS mu,
            ord IN ('01', '11') AND drifts AS has_drift,
            CASE ord WHEN '00' THEN v00 WHEN '01' THEN v01 WHEN '10' THEN v10 ELSE v11 END AS variance,
            CASE ord WHEN '00' THEN a00 WHEN '01' THEN a01 WHEN '10' THEN a10 ELSE a11 END AS aic FROM {p}_pick""",
        f"{p}_end": f"""SELECT fold_name, ad_unit, any_value(t0) AS t0, arg_max(level, date) AS level, arg_max(e, date) AS last_e,
            arg_max(de, date) AS last_de, bool_or(abs(y - c) > 1e-6) AS has_spikes, bool_or(step <> 0) AS has_steps,
            bool_or(holiday_name IS NOT NULL) AS has_holiday, bool_or(yearly IS NOT NULL) AS has_yearly
            FROM {p}_lag GROUP BY ALL""",
        f"{p}_fit": f"SELECT * FROM {p}_par JOIN {p}_end USING (fold_name, ad_unit) JOIN {p}_line USING (fold_name, ad_unit)",
        f"{p}_ahead": f"""SELECT z.*, h, last_date + h::INTEGER AS fd FROM {p}_fit z, range(1, 93) q(h)""",
        f"{p}_parts": f"""SELECT a.fold_name, a.ad_unit, a.fd AS forecast_date, a.icpt + a.slope * (a.fd - a.t0) AS trend,
            k.weekly, j.yearly, coalesce(o.heff, 0) AS heff, a.level,
            CASE WHEN a.d = 0 THEN a.mu + a.phi ** a.h * (a.last_e - a.mu)
                WHEN a.phi = 0 THEN a.last_e + a.h * a.mu
                ELSE a.last_e + a.h * a.mu + (a.last_de - a.mu) * list_sum([a.phi ** i FOR i IN range(1, a.h + 1)]) END AS ar,
            a.variance * CASE WHEN a.d = 0 THEN list_sum([(a.phi ** i) ** 2 FOR i IN range(0, a.h)])
                ELSE list_sum([((1 - a.phi ** i) / (1 - a.phi)) ** 2 FOR i IN range(1, a.h + 1)]) END AS spread
            FROM {p}_ahead a LEFT JOIN {p}_week k ON k.fold_name = a.fold_name AND k.ad_unit = a.ad_unit AND k.dw = dayofweek(a.fd)
            LEFT JOIN {p}_year j ON j.fold_name = a.fold_name AND j.ad_unit = a.ad_unit AND j.mo = month(a.fd)
            LEFT JOIN x_hol g ON g.holiday_date = a.fd
            LEFT JOIN {p}_hol o ON o.fold_name = a.fold_name AND o.ad_unit = a.ad_unit AND o.holiday_name = g.holiday_name""",
        f"{p}_dec": f"""SELECT *, trend + coalesce(weekly, 0) + coalesce(yearly, 0) + heff + level + ar AS fv,
            {Z95} * sqrt(spread) AS half FROM {p}_parts""",
        f"{p}_exp": f"""SELECT l.fold_name, l.ad_unit, l.date, l.y, sqrt(q.variance) AS sd,
            l.level + icpt + slope * t + weekly + coalesce(yearly, 0) + coalesce(heff, 0)
            + CASE WHEN q.d = 0 THEN q.mu + q.phi * (coalesce(l.e1, q.mu) - q.mu)
                ELSE coalesce(l.e1, 0) + q.mu + q.phi * (coalesce(l.de1, q.mu) - q.mu) END AS ex
            FROM {p}_lag l JOIN {p}_par q USING (fold_name, ad_unit)""",
        f"{p}_z": f"""SELECT *, abs((y - ex) / sd) / sqrt(2.0) AS xx, 1 / (1 + 0.3275911 * (abs((y - ex) / sd) / sqrt(2.0))) AS tt FROM {p}_exp""",
        f"{p}_anom": f"""SELECT date, ad_unit, fold_name, y AS daily_impressions, pr > 0.95 AS is_anomaly,
            ex - {Z95} * sd AS lower_bound, ex + {Z95} * sd AS upper_bound, pr AS anomaly_probability
            FROM (SELECT *, 1 - (0.254829592 * tt - 0.284496736 * tt ** 2 + 1.421413741 * tt ** 3 - 1.453152027 * tt ** 4
                + 1.061405429 * tt ** 5) * exp(-xx * xx) AS pr FROM {p}_z)""",
        f"{p}_fc": f"""SELECT forecast_date, ad_unit, 'structural' AS model_name, fold_name, fv AS forecast_value,
            fv - half AS forecast_lower, fv + half AS forecast_upper FROM {p}_dec""",
    }


def _recursion(source: str, order: int) -> str:
    """Autoregressions up to ``order`` of the autocovariances r0, r1, ...: coefficients p<order>_<lag> and error v<order>."""
    long = f"SELECT *, r0 AS v0 FROM {source}"
    for k in range(1, order + 1):
        explained = "".join(f" - p{k - 1}_{j} * r{k - j}" for j in range(1, k))
        long = f"SELECT *, CASE WHEN v{k - 1} > 1e-9 * r0 THEN (r{k}{explained}) / v{k - 1} ELSE 0 END AS p{k}_{k} FROM ({long})"
        updated = "".join(f", p{k - 1}_{j} - p{k}_{k} * p{k - 1}_{k - j} AS p{k}_{j}" for j in range(1, k))
        long = f"SELECT *, v{k - 1} * (1 - p{k}_{k} ** 2) AS v{k}{updated} FROM ({long})"
    return long


def _moving_average(prefix: str, order: int = 7) -> dict[str, str]:
    """Two-stage regression on the remainder: long autoregression, then last value and last surprise."""
    p, lags, by = prefix, range(1, order + 1), "fold_name, ad_unit"
    long = _recursion(f"{p}_acov", order)

    def clip(over: str, under: str, least: str = "0") -> str:
        return f"least(greatest(CASE WHEN {under} > {least} THEN ({over}) / ({under}) ELSE 0 END, -0.98), 0.98)"

    det = "(v1 * va - c1a * c1a)"
    both = [clip(x, det, "1e-9 * v1 * va") for x in ("c1 * va - ca * c1a", "ca * v1 - c1 * c1a")]
    orders = [(0, 0, "0.0", "0.0"), (1, 0, clip("c1", "v1"), "0.0"), (0, 1, "0.0", clip("ca", "va")), (1, 1, *both)]
    tried = " UNION ALL ".join(f"SELECT *, {i} AS rank, {a} AS p, {q} AS q, {f} AS phi, {t} AS theta FROM {p}_mom" for i, (a, q, f, t) in enumerate(orders))
    error = "vx - 2 * phi * c1 - 2 * theta * ca + phi ** 2 * v1 + theta ** 2 * va + 2 * phi * theta * c1a"
    return {
        f"{p}_z": f"""SELECT *, CASE WHEN d = 0 THEN e ELSE de END - mean AS z0 FROM (SELECT {by}, l.date, l.e, l.de, f.d,
            avg(CASE WHEN f.d = 0 THEN l.e ELSE l.de END) OVER (PARTITION BY {by}) AS mean FROM {p}_lag l JOIN {p}_fit f USING ({by}))""",
        f"{p}_zl": f"""SELECT *, {', '.join(f'lag(z0, {k}) OVER w AS z{k}' for k in lags)} FROM {p}_z WINDOW w AS (PARTITION BY {by} ORDER BY date)""",
        f"{p}_acov": f"SELECT {by}, {', '.join(f'coalesce(sum(z0 * z{k}) / count(z0), 0) AS r{k}' for k in (0, *lags))} FROM {p}_zl GROUP BY ALL",
        f"{p}_sur": f"SELECT z.*, z0 {' '.join(f'- p{order}_{k} * z{k}' for k in lags)} AS a FROM {p}_zl z JOIN ({long}) USING ({by})",
        f"{p}_mom": f"""SELECT {by}, d, mean, count(a1) AS n, max(spread) AS spread, var_pop(z0) FILTER (a1 IS NOT NULL) AS vx,
            var_pop(z1) FILTER (a1 IS NOT NULL) AS v1, var_pop(a1) AS va, covar_pop(z0, z1) FILTER (a1 IS NOT NULL) AS c1,
            covar_pop(z0, a1) AS ca, covar_pop(z1, a1) AS c1a
            FROM (SELECT *, lag(a) OVER (PARTITION BY {by} ORDER BY date) AS a1, var_pop(z0) OVER (PARTITION BY {by}) AS spread FROM {p}_sur) GROUP BY ALL""",
        f"{p}_ma": f"""SELECT {by}, d, coalesce(mean, 0) AS mean, n, p, q, phi, theta, CASE WHEN n < 14 THEN coalesce(spread, 0) ELSE variance END AS variance,
            CASE WHEN n >= 14 THEN aic END AS aic FROM (SELECT *, round(n * ln(variance) + 2.0 * (1 + p + q), 6) AS aic
            FROM (SELECT *, greatest({error}, 1e-9) AS variance FROM ({tried}))) WHERE n >= 14 OR rank = 0
            QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY aic, rank) = 1""",
    }


def seasons(train: str, longest: int = 60) -> dict[str, str]:
    """Peaks of the autocorrelation of the differences of each series."""
    by = "fold_name, ad_unit"
    return {
        "x_sea_d": f"""SELECT {by}, i - 1 AS i, u - avg(u) OVER (PARTITION BY {by}) AS x, size FROM (SELECT {by}, row_number() OVER w AS i,
            daily_impressions - lag(daily_impressions) OVER w AS u, max(abs(daily_impressions)) OVER (PARTITION BY {by}) AS size
            FROM {train} WINDOW w AS (PARTITION BY {by} ORDER BY date)) WHERE u IS NOT NULL""",
        "x_sea_n": f"SELECT {by}, count(*) AS n, 5.0 / sqrt(count(*)) AS clear, sum(x * x) AS z, max(size) AS size FROM x_sea_d GROUP BY ALL",
        "x_sea_r": f"""SELECT a.fold_name, a.ad_unit, q.k, coalesce(sum(a.x * b.x), 0) / max(z) AS r, max(n) AS n, max(clear) AS clear FROM x_sea_d a
            JOIN x_sea_n USING ({by}) CROSS JOIN range(1, {longest + 2}) q(k) LEFT JOIN x_sea_d b
            ON b.fold_name = a.fold_name AND b.ad_unit = a.ad_unit AND b.i = a.i + q.k WHERE z > 1e-12 * x_sea_n.size ** 2 GROUP BY ALL""",
        "x_sea_p": f"""SELECT * FROM (SELECT *, lag(r) OVER w AS earlier, lead(r) OVER w AS later FROM x_sea_r WINDOW w AS (PARTITION BY {by} ORDER BY k))
            WHERE k BETWEEN 2 AND {longest} AND r > earlier AND r >= later AND r > clear AND 2 * k <= n""",
        "x_sea": f"""SELECT * FROM x_sea_p a WHERE NOT EXISTS (SELECT 1 FROM x_sea_p b WHERE b.fold_name = a.fold_name AND b.ad_unit = a.ad_unit
            AND (b.r > a.r + a.clear OR (b.k < a.k AND a.k % b.k = 0 AND a.r <= b.r + a.clear)))""",
    }


def orders(remainder: str, most: int = 5) -> dict[str, str]:
    """Differencing by the KPSS statistic, autoregression of least AIC, and the remainder continued with both."""
    by, past = "fold_name, ad_unit", most + 2
    levels = " UNION ALL ".join(f"SELECT {by}, {d} AS d, i, x{d} AS x FROM x_ord_x WHERE x{d} IS NOT NULL" for d in range(3))
    tried = " UNION ALL ".join(
        f"SELECT *, {p} AS p, [{', '.join(f'p{p}_{j}' for j in range(1, p + 1))}]::DOUBLE[] AS phi, greatest(g * v{p}, 1e-9) AS variance FROM x_ord_v" for p in range(most + 1)
    )
    a = ["1.0", *[f"-coalesce(phi[{k}], 0)" for k in range(1, past + 1)]]
    weights = []
    for d in range(3):
        weights.append("[" + ", ".join(f"-({x})" for x in a[1:]) + "]")
        a = [a[0], *[f"({y}) - ({x})" for x, y in zip(a, a[1:])]]
    zeros = "[" + ", ".join(["0.0"] * past) + "]::DOUBLE[]"
    return {
        "x_ord_x": f"""SELECT {by}, date, row_number() OVER w AS i, e AS x0, e - lag(e) OVER w AS x1, (e - lag(e) OVER w) - (lag(e) OVER w - lag(e, 2) OVER w) AS x2
            FROM {remainder} WHERE e IS NOT NULL WINDOW w AS (PARTITION BY {by} ORDER BY date)""",
        "x_ord_z": f"SELECT *, x - avg(x) OVER (PARTITION BY {by}, d) AS z FROM ({levels})",
        "x_ord_n": f"""SELECT *, floor(4 * (n / 100) ** 0.25) AS reach, max(n) OVER (PARTITION BY {by}) AS n_days
            FROM (SELECT {by}, d, count(*) AS n, avg(x) AS m, avg(z * z) AS g FROM x_ord_z GROUP BY ALL)""",
        "x_ord_r": f"""SELECT {by}, d, q.k, list_dot_product(l[1:len(l) - q.k], l[q.k + 1:len(l)]) / (n * g) AS r, reach FROM x_ord_n
            JOIN (SELECT {by}, d, list(z ORDER BY i) AS l FROM x_ord_z GROUP BY ALL) USING ({by}, d) CROSS JOIN range(1, 40) q(k)
            WHERE g > 1e-9 AND q.k <= greatest(reach, {most}) AND q.k < n""",
        "x_ord_s": f"""SELECT {by}, d, sum(s * s) AS q FROM (SELECT {by}, d, sum(z) OVER (PARTITION BY {by}, d ORDER BY i) AS s FROM x_ord_z) GROUP BY ALL""",
        "x_ord_k": f"""SELECT {by}, d, CASE WHEN n_days >= 14 AND g > 1e-9 THEN CASE WHEN lr > 1e-9 THEN q / (g * lr) / n / n ELSE 0 END END AS kpss
            FROM x_ord_n JOIN x_ord_s USING ({by}, d) LEFT JOIN (SELECT {by}, d, 1 + 2 * sum(r * (1 - k / (reach + 1.0))) AS lr
            FROM x_ord_r WHERE k <= reach GROUP BY ALL) USING ({by}, d)""",
        "x_ord_c": f"""SELECT *, CASE WHEN NOT coalesce(kpss_0 > 0.463, false) THEN 0 WHEN NOT coalesce(kpss_1 > 0.463, false) THEN 1 ELSE 2 END AS d
            FROM (SELECT {by}, max(kpss) FILTER (d = 0) AS kpss_0, max(kpss) FILTER (d = 1) AS kpss_1 FROM x_ord_k GROUP BY ALL)""",
        "x_ord_a": f"""SELECT {by}, d, kpss_0, kpss_1, n, n_days, g, m, 1.0::DOUBLE AS r0,
            {', '.join(f'coalesce(max(r) FILTER (k = {k}), 0) AS r{k}' for k in range(1, most + 1))}
            FROM x_ord_c JOIN x_ord_n USING ({by}, d) LEFT JOIN x_ord_r USING ({by}, d) GROUP BY ALL""",
        "x_ord_v": _recursion("x_ord_a", most),
        "x_ord": f"""SELECT {by}, d, kpss_0, kpss_1, n, n_days, CASE WHEN n_days >= 14 THEN p ELSE 0 END AS p, CASE WHEN n_days >= 14 THEN phi ELSE [] END AS phi,
            CASE WHEN n_days >= 14 THEN variance END AS variance, CASE WHEN n_days >= 14 THEN aic END AS aic,
            CASE WHEN d = 0 THEN m WHEN d = 1 AND abs(m) > 1.96 * sqrt(g / n) THEN m ELSE 0 END AS mu
            FROM (SELECT *, round(n * ln(variance) + 2.0 * (1 + p), 6) AS aic FROM ({tried})) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY aic, p) = 1""",
        "x_ord_w": f"""SELECT {by}, variance, mu * (1 - coalesce(list_sum(phi), 0)) AS c, CASE d WHEN 0 THEN {weights[0]} WHEN 1 THEN {weights[1]} ELSE {weights[2]} END::DOUBLE[] AS w,
            list_concat(l, {zeros})[1:{past}] AS l FROM x_ord JOIN (SELECT {by}, list(x0 ORDER BY date DESC) AS l FROM x_ord_x GROUP BY ALL) USING ({by})""",
        "x_ord_fc": f"""WITH RECURSIVE f AS (SELECT {by}, variance, c, w, 0 AS h, l, list_concat([1.0::DOUBLE], {zeros})[1:{past}] AS psi, 0.0::DOUBLE AS growth FROM x_ord_w
            UNION ALL SELECT {by}, variance, c, w, h + 1, list_prepend(c + list_dot_product(w, l), l)[1:{past}], list_prepend(list_dot_product(w, psi), psi)[1:{past}],
            growth + psi[1] ** 2 FROM f WHERE h < 92) SELECT {by}, h, l[1] AS remainder, variance * growth AS variance FROM f WHERE h > 0""",
    }


def _scores(forecasts: str, daily: str) -> str:
    return f"""
        WITH nv AS (SELECT fold_name, ad_unit, avg(abs(df)) AS ne FROM (
                 SELECT f.fold_name, d.ad_unit, d.daily_impressions - lag(d.daily_impressions) OVER (
                     PARTITION BY f.fold_name, d.ad_unit ORDER BY d.date) AS df
                 FROM {daily} d JOIN x_folds f ON d.date BETWEEN f.train_start AND f.train_end) GROUP BY ALL),
             pr AS (SELECT c.*, d.daily_impressions AS a FROM {forecasts} c JOIN x_folds f ON f.fold_name = c.fold_name
                 JOIN {daily} d ON d.ad_unit = c.ad_unit AND d.date = c.forecast_date
                 WHERE d.date BETWEEN f.test_start AND f.test_end),
             sc AS (SELECT model_name, fold_name, ad_unit, 100 * avg(abs(forecast_value - a) / nullif(a, 0)) AS mape,
                 sqrt(avg((forecast_value - a) ** 2)) AS rmse, avg(abs(forecast_value - a)) AS mae,
                 100 * avg((a >= forecast_lower AND a <= forecast_upper)::INT::DOUBLE) AS coverage FROM pr GROUP BY ALL)
        SELECT sc.*, mae / nullif(ne, 0) AS mase FROM sc LEFT JOIN nv USING (fold_name, ad_unit)"""


def _long(scores: str) -> str:
    one = " UNION ALL ".join(
        f"SELECT model_name, fold_name, ad_unit, '{m}' AS metric_name, {m} AS metric_value FROM {scores}"
        for m in ("mape", "rmse", "mae", "mase", "coverage")
    )
    return f"""SELECT s.*, f.test_start, f.test_end FROM ({one}) s JOIN x_folds f USING (fold_name)"""


def _comparison(metrics: str) -> str:
    return f"""
        WITH one AS (SELECT model_name, fold_name, metric_name, avg(metric_value) AS mean_value,
            quantile_disc(metric_value, 0.5) AS median_value, stddev_samp(metric_value) AS std_value,
            min(metric_value) AS min_value, max(metric_value) AS max_value FROM {metrics} GROUP BY ALL)
        SELECT * FROM one UNION ALL
        SELECT model_name, 'cross_fold_avg', metric_name, avg(mean_value), avg(median_value), avg(std_value),
            min(min_value), max(max_value) FROM one GROUP BY model_name, metric_name"""


def _impact(metrics: str, daily: str) -> str:
    return f"""
        WITH tr AS (SELECT f.fold_name, d.ad_unit, avg(d.daily_impressions) AS v FROM {daily} d
            JOIN x_folds f ON d.date BETWEEN f.train_start AND f.train_end GROUP BY ALL)
        SELECT model_name, fold_name, ad_unit, v AS avg_daily_impressions, metric_value AS mape, 5.5::DOUBLE AS cpm,
            v * 5.5::DOUBLE * metric_value / 100000 AS daily_revenue_at_risk,
            365 * v * 5.5::DOUBLE * metric_value / 100000 AS annual_revenue_at_risk
        FROM {metrics} JOIN tr USING (fold_name, ad_unit) WHERE metric_name = 'mape'"""


_FOLD_ROWS = [(f.name, f.train_start, f.train_end, f.test_start, f.test_end) for f in FOLDS]


def _in_fold(source: str, part: str) -> str:
    return f"SELECT s.*, f.fold_name FROM {source} s JOIN x_folds f ON s.date BETWEEN f.{part}_start AND f.{part}_end"


def _future(daily: str) -> str:
    grid = f"(SELECT CAST(g.d AS DATE) AS date, u.ad_unit, f.fold_name FROM x_folds f, generate_series(f.test_start, f.test_end, INTERVAL 1 DAY) g(d), (SELECT DISTINCT ad_unit FROM {daily}) u)"
    return featured(grid, "s.date, s.ad_unit, s.fold_name")


LIBRARY: dict[str, str] = {
    "x_hol": _holiday_sql(),
    "x_folds": f"""SELECT fold_name, train_start::DATE AS train_start, train_end::DATE AS train_end,
        test_start::DATE AS test_start, test_end::DATE AS test_end
        FROM ({_values(_FOLD_ROWS, 'fold_name, train_start, train_end, test_start, test_end')})""",
    "x_hourly": _hourly("lineitem", "l_shipdate", "l_linestatus = 'O'", "l_returnflag", "CAST(l_quantity AS BIGINT)"),
    "x_hourly_wide": _hourly(
        "lineitem JOIN part ON p_partkey = l_partkey", "l_shipdate", "l_linestatus = 'O'", "p_brand",
        "CAST(l_quantity AS BIGINT)",
    ),
    "x_hourly_gappy": _hourly(
        "orders", "o_orderdate", "o_orderstatus = 'O'", "o_orderpriority", "CAST(floor(o_totalprice) AS BIGINT)"
    ),
    "x_hourly_clock": _hourly("events", "ts", "user_id % 2 = 0", "event_type", "1"),
    "x_raw": _raw("x_hourly"),
    "x_raw_wide": _raw("x_hourly_wide"),
    "x_raw_gappy": _raw("x_hourly_gappy"),
    "x_raw_clock": _raw("x_hourly_clock"),
    "x_fills": _fills("x_raw", START, END),
    "x_fills_wide": _fills("x_raw_wide", START, END),
    "x_fills_gappy": _fills("x_raw_gappy", GAPPY_START, GAPPY_END),
    "x_built": featured("x_raw", _VOLUMES),
    "x_whole": "SELECT date, ad_unit, daily_impressions, desktop_impressions, mobile_impressions FROM x_raw UNION ALL SELECT * FROM x_fills",
    "x_whole_wide": "SELECT date, ad_unit, daily_impressions, desktop_impressions, mobile_impressions FROM x_raw_wide UNION ALL SELECT * FROM x_fills_wide",
    "x_whole_gappy": "SELECT date, ad_unit, daily_impressions, desktop_impressions, mobile_impressions FROM x_raw_gappy UNION ALL SELECT * FROM x_fills_gappy",
    "x_daily": featured("x_whole", _VOLUMES),
    "x_daily_wide": featured("x_whole_wide", _VOLUMES),
    "x_daily_gappy": featured("x_raw_gappy", _VOLUMES),
    "x_filled_gappy": featured("x_whole_gappy", _VOLUMES),
    "x_train": _in_fold("x_daily", "train"),
    "x_train_wide": _in_fold("x_daily_wide", "train"),
    "x_future": _future("x_daily"),
    "x_future_wide": _future("x_daily_wide"),
    "x_zero": zero_shot("x_train"),
    "x_zero_wide": zero_shot("x_train_wide"),
    "x_reg": regression_fit("x_train"),
    "x_reg_wide": regression_fit("x_train_wide"),
    "x_xreg": regression_forecast("x_reg", "x_future"),
    "x_xreg_wide": regression_forecast("x_reg_wide", "x_future_wide"),
    **regression_ar("x_train_wide"),
    "x_ar_fc": f"""WITH v AS (SELECT f.date, f.ad_unit, f.fold_name, f.date - p.last_date AS h, p.sigma, p.phi,
        p.intercept + p.c1 * f.day_of_week + p.c2 * f.is_weekend::INT + p.c3 * f.is_holiday::INT
        + p.c4 * coalesce(f.days_to_next_holiday, 0) + p.phi ** (f.date - p.last_date) * p.last_e AS v
        FROM x_future_wide f JOIN x_ar p ON p.fold_name = f.fold_name AND p.ad_unit = f.ad_unit WHERE f.date > p.last_date),
        s AS (SELECT *, {Z95} * sigma * sqrt((1 - phi ** (2 * h)) / (1 - phi * phi)) AS half FROM v)
        SELECT date AS forecast_date, ad_unit, 'structural_xreg' AS model_name, fold_name, v AS forecast_value,
            v - half AS forecast_lower, v + half AS forecast_upper FROM s""",
    "x_fc": "SELECT * FROM x_zero UNION ALL SELECT * FROM x_xreg",
    "x_fc_wide": "SELECT * FROM x_zero_wide UNION ALL SELECT * FROM x_xreg_wide",
    "x_fc_all": "SELECT * FROM x_fc UNION ALL SELECT * FROM x_st_fc",
    "x_scores": _scores("x_fc", "x_daily"),
    "x_scores_wide": _scores("x_fc_wide", "x_daily_wide"),
    "x_scores_all": _scores("x_fc_all", "x_daily"),
    "x_metrics": _long("x_scores"),
    "x_metrics_wide": _long("x_scores_wide"),
    "x_metrics_all": _long("x_scores_all"),
    "x_cmp": _comparison("x_metrics_wide"),
    "x_cmp_all": _comparison("x_metrics_all"),
    "x_impact": _impact("x_metrics_wide", "x_daily_wide"),
    "x_impact_all": _impact("x_metrics_all", "x_daily"),
    "x_cv": "SELECT ad_unit, stddev_samp(daily_impressions) / nullif(avg(daily_impressions), 0) AS cv FROM x_daily_wide GROUP BY ad_unit",
    "x_ev": f"SELECT ad_unit, date::DATE AS date, event, category FROM ({_values([(u, d, n, c) for u, es in EVENTS.items() for d, n, c in es], 'ad_unit, date, event, category')})",
    "x_gd": _values(GUIDANCE, "category, level, guidance"),
    **_structural("x_st", "x_train"),
    **_structural("x_sw", "x_train_wide"),
    **_moving_average("x_sw"),
    **seasons("x_train_wide"),
    **orders("x_sw_lag"),
    "x_rt_train": """SELECT *, 'retrain' AS fold_name FROM x_daily
        WHERE date BETWEEN DATE '2001-11-04' - 730 AND DATE '2001-11-04' - 92""",
    **_structural("x_rt", "x_rt_train"),
}


def compose(statement: str) -> str:
    """Prefix ``statement`` with the library entries it uses, in order of dependence."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bx_\w+", text)):
            if name in LIBRARY and name not in order:
                visit(LIBRARY[name])
                order.append(name)

    visit(statement)
    if not order:
        return statement
    return "WITH " + ",\n".join(f"{n} AS ({LIBRARY[n]})" for n in order) + "\n" + statement
