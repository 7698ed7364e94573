"""Queries over ordered series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import frames as fr
from tidewatch.functions import spectral as sp
from tidewatch.functions.scalars import safe_ratio
from tidewatch.operators import embedding, features, normalize, ordered, resample, seasonal, tolerance
from tidewatch.plans.roles import (
    ALL, LABELLED_SQL, TAGGED_SQL, TYPE, USER, Query, events, frame_sql, labelled, order_sql, own_mean_sql, ratio_sql,
    rounded, rounded_sql, stat_names, stats_sql, tagged_events,
)
from tidewatch.series import over_series, series_stats

EV = "SELECT event_id, event_type, user_id, ts, value FROM events"
POS_SQL = f"row_number() OVER {order_sql()} - 1"


def _ev(spark, sf):
    return events(spark, sf).select("event_id", "event_type", "user_id", "ts", "value")


def _ids(df, *columns):
    return rounded(df.select("event_id", *columns))


# --- flagship -------------------------------------------------------------------------------


def flagged_series(spark, sf):
    rows = _ev(spark, sf)
    stats = series_stats(rows, TYPE.series)  # counted once, used by both steps
    rows = normalize.by_percentile(rows, TYPE, stats=stats)
    rows = over_series(rows, TYPE, lambda r, w: _with_stats(r, w, (5, 25)), before=25, stats=stats)
    return rounded(
        rows.groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.abs("value_w25_zscore") > 3).alias("flags"),
            F.max("value_w25_std").alias("max_std"),
            F.avg("value_w25_mean").alias("avg_mean"),
        )
    ).orderBy(F.desc("flags"), "event_type")


def _with_stats(rows, w, windows=fr.WINDOWS, **kw):
    rows = fr.with_references(rows, w, "value", windows)
    rows = rows.withColumns(fr.base_stat_windows("value", w, windows))
    return rows.withColumns(fr.base_stats("value", windows=windows, **kw)).drop(*fr.helper_names(windows))


P90 = f"SELECT * REPLACE (value / nullif(quantile_cont(value, 0.9::DOUBLE) OVER (PARTITION BY event_type), 0) AS value) FROM ({EV})"

FLAGGED_SQL = f"""
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE abs(value_w25_zscore) > 3) AS flags,
       round(max(value_w25_std), 6) AS max_std, round(avg(value_w25_mean), 6) AS avg_mean
FROM ({stats_sql(P90, windows=(5, 25), entropy=False)}) GROUP BY event_type"""


# --- row frames -----------------------------------------------------------------------------


def lag_zero_fill(spark, sf):
    rows = over_series(
        _ev(spark, sf), USER, lambda r, w: r.withColumns({f"lag{i}": fr.lag_or_zero(F.col("value"), w, i) for i in fr.LAGS}), before=15
    )
    return _ids(rows, *[f"lag{i}" for i in fr.LAGS])


LAG_SQL = "SELECT event_id, " + ", ".join(
    f"coalesce(lag(value, {i}) OVER {order_sql('user_id')}, 0) AS lag{i}" for i in fr.LAGS
) + " FROM events"


def _differences(spark, sf, size):
    def fn(r, w):
        r = r.withColumn("first_diff", size(fr.step_difference(F.col("value"), w)))
        return r.withColumn("second_diff", size(fr.step_difference(F.col("first_diff"), w)))

    return _ids(over_series(_ev(spark, sf), TYPE, fn, before=3), "first_diff", "second_diff")


def _differences_sql(size):
    step = f"CASE WHEN {POS_SQL} > 1 THEN {{c}} - lag({{c}}) OVER {order_sql()} ELSE 0 END"
    return f"""
SELECT event_id, round(first_diff, 6) AS first_diff, round({size}({step.format(c='first_diff')}), 6) AS second_diff
FROM (SELECT *, {size}({step.format(c='value')}) AS first_diff FROM ({EV}))"""


def long_differences(spark, sf):
    def fn(r, w):
        lag = {i: fr.lag_or_zero(F.col("value"), w, i) for i in (1, 5, 10)}
        return r.withColumns({
            "first_long_diff": lag[5] - lag[1], "second_long_diff": (lag[10] - lag[5]) - (lag[5] - lag[1]),
        })

    return _ids(over_series(_ev(spark, sf), TYPE, fn, before=10), "first_long_diff", "second_long_diff")


LONG_DIFF_SQL = f"""
SELECT event_id, round(l5 - l1, 6) AS first_long_diff, round((l10 - l5) - (l5 - l1), 6) AS second_long_diff
FROM (SELECT event_id, {', '.join(f'coalesce(lag(value, {i}) OVER {order_sql()}, 0) AS l{i}' for i in (1, 5, 10))} FROM ({EV}))"""


def _stats_query(names, fallback, entropy, spec=TYPE):
    def build(spark, sf):
        rows = over_series(
            _ev(spark, sf), spec, lambda r, w: _with_stats(r, w, fallback=fallback, entropy=entropy), before=50
        )
        return _ids(rows, *names)

    part = spec.series[0]
    sql = f"SELECT event_id, {rounded_sql(names)} FROM ({stats_sql(EV, fallback=fallback, entropy=entropy, part=part)})"
    return build, sql


MSK = [f"value_w{n}_{s}" for n in (5, 25, 50) for s in ("mean", "std", "kurt")]
ZS = [f"value_w{n}_zscore" for n in (5, 25, 50)]
ENT = [f"value_w{n}_entropy" for n in (5, 25, 50)]


def lag_ratios(spark, sf):
    def fn(r, w):
        r = r.withColumns({f"_l{i}": fr.lag_or_zero(F.col("value"), w, i) for i in fr.LAGS})
        return r.withColumns({f"lag{i}_ratio": safe_ratio(F.col(f"_l{i}"), F.col("_l1")) for i in fr.RATIO_LAGS})

    return _ids(over_series(_ev(spark, sf), USER, fn, before=15), *[f"lag{i}_ratio" for i in fr.RATIO_LAGS])


LAG_RATIO_SQL = (
    "SELECT event_id, " + ", ".join(f"round_even({ratio_sql(f'l{i}', 'l1')}, 6) AS lag{i}_ratio" for i in fr.RATIO_LAGS)
    + " FROM (SELECT event_id, "
    + ", ".join(f"coalesce(lag(value, {i}) OVER {order_sql('user_id')}, 0) AS l{i}" for i in fr.LAGS) + " FROM events)"
)


def step_ratios(spark, sf):
    def fn(r, w):
        r = r.withColumn("first_ratio", fr.step_ratio(F.col("value"), w))
        return r.withColumn("second_ratio", fr.step_ratio(F.col("first_ratio"), w))

    return _ids(over_series(_ev(spark, sf), TYPE, fn, before=3), "first_ratio", "second_ratio")


def _step_ratio_sql(c):
    prev = f"lag({c}) OVER {order_sql()}"
    return f"CASE WHEN {POS_SQL} > 1 AND {prev} > 0 THEN {c} / {prev} ELSE 1000 END"


STEP_RATIO_SQL = f"""
SELECT event_id, round(first_ratio, 6) AS first_ratio, round({_step_ratio_sql('first_ratio')}, 6) AS second_ratio
FROM (SELECT *, {_step_ratio_sql('value')} AS first_ratio FROM ({EV}))"""


def own_mean_ratio(spark, sf):
    rows = over_series(_ev(spark, sf), USER, lambda r, w: r.withColumn("value_ratio", fr.ratio_to_own_mean(F.col("value"), w)), before=10)
    return _ids(rows, "value_ratio")


def trend_removed(spark, sf):
    rows = over_series(_ev(spark, sf), TYPE, lambda r, w: _with_stats(r, w), before=50)
    return _ids(rows.withColumn("trend_removed", F.col("value") - F.col("value_w50_mean")), "trend_removed")


def seasonal_component(spark, sf):
    def fn(r, w):
        r = _with_stats(r, w).withColumn("t", F.col("value") - F.col("value_w50_mean"))
        r = r.withColumn("_frame", features.full_frame("t", w, 50))
        return r.withColumn("season", F.coalesce(sp.seasonal_last(F.col("_frame")), F.lit(0.0))).drop("_frame")

    return _ids(over_series(_ev(spark, sf), TYPE, fn, before=99), "season")


def season_sql(source: str, col: str) -> str:
    """SELECT adding ``season``: the strongest oscillation of the last 50 values at the row."""
    f = frame_sql(50)
    return f"""
SELECT r.*, coalesce(s.season, 0.0::DOUBLE) AS season FROM ({source}) r LEFT JOIN (
  SELECT event_id, arg_max(last_value, c * c + s * s) AS season FROM (
    SELECT event_id,
      list_inner_product(fr, cl) AS c, list_inner_product(fr, sl) AS s, list_inner_product(fr, nl) / 50 AS last_value
    FROM (SELECT event_id, CASE WHEN count({col}) OVER {f} = 50 THEN list({col}) OVER {f} END AS fr FROM ({source})) x,
      (SELECT j, [cos(2 * pi() * j * t / 50) FOR t IN range(50)] AS cl, [sin(2 * pi() * j * t / 50) FOR t IN range(50)] AS sl,
              [cos(2 * pi() * j * (t + 1) / 50) FOR t IN range(50)] AS nl
       FROM range(1, 26) b(j)) basis
    WHERE fr IS NOT NULL) GROUP BY event_id) s USING (event_id)"""


TREND = f"SELECT *, value - value_w50_mean AS value_trend_removed FROM ({stats_sql(EV)})"
SEASON_SQL = f"SELECT event_id, round(season, 6) AS season FROM ({season_sql(TREND, 'value_trend_removed')})"


# --- feature sets ---------------------------------------------------------------------------

LAG_COLS = [f"value_lag{i}" for i in fr.LAGS]
RATIO_COLS = [f"value_lag{i}_ratio" for i in fr.RATIO_LAGS]


def _level_one(size: str, first_ratio: str) -> str:
    step = f"CASE WHEN {POS_SQL} > 1 THEN value - lag(value) OVER {order_sql()} ELSE 0 END"
    lags = ", ".join(f"coalesce(lag(value, {i}) OVER {order_sql()}, 0) AS value_lag{i}" for i in fr.LAGS)
    return f"SELECT *, {lags}, {size}({step}) AS first_diff, {_step_ratio_sql('value')} AS {first_ratio} FROM ({EV})"


def _level_two(source: str, size: str, first_ratio: str) -> str:
    step = f"CASE WHEN {POS_SQL} > 1 THEN first_diff - lag(first_diff) OVER {order_sql()} ELSE 0 END"
    ratios = ", ".join(f"{ratio_sql(f'value_lag{i}', 'value_lag1')} AS value_lag{i}_ratio" for i in fr.RATIO_LAGS)
    return f"""SELECT *, {size}({step}) AS second_diff, {size}(value_lag5 - value_lag1) AS first_long_diff,
  {size}((value_lag10 - value_lag5) - (value_lag5 - value_lag1)) AS second_long_diff, {ratios},
  {_step_ratio_sql(first_ratio)} AS second_diff_ratio, {ratio_sql('value_lag5', 'value_lag1')} AS first_long_ratio
  FROM ({source})"""


SET_A = [*LAG_COLS, "first_diff", "second_diff", "first_long_diff", "second_long_diff", *RATIO_COLS, "first_ratio",
         "second_diff_ratio", "first_long_ratio", *stat_names(entropy=False)]
SET_A_SQL = (
    f"SELECT event_id, {rounded_sql(SET_A)} FROM "
    f"({stats_sql(_level_two(_level_one('', 'first_ratio'), '', 'first_ratio'), fallback=False, entropy=False)})"
)

SET_C = [*LAG_COLS, "first_diff", "second_diff", "first_long_diff", "second_long_diff", *RATIO_COLS, "first_diff_ratio",
         "second_diff_ratio", "value_ratio", *stat_names()]
C_STATS = ("std", "kurt", "entropy", "zscore", "mean")
C_RATIOS = [f"value_w25_{s}_ratio" for s in C_STATS]
SET_C_SQL = f"""
SELECT event_id, {rounded_sql(SET_C)}, {rounded_sql(C_RATIOS)} FROM (
  SELECT *, {own_mean_sql('value')} AS value_ratio,
    {', '.join(f"{own_mean_sql(f'value_w25_{s}')} AS value_w25_{s}_ratio" for s in C_STATS)}
  FROM ({stats_sql(_level_two(_level_one('abs', 'first_diff_ratio'), 'abs', 'first_diff_ratio'))}))"""

B_STATS = ("std", "kurt", "entropy", "zscore", "mean")
B_RATIOS = ["value_ratio", *[f"value_w50_{s}_ratio" for s in B_STATS]]
SET_B = [*stat_names(), *B_RATIOS, "value_trend_removed", "value_season_trend_removed"]
NOM = [f"nom_value_w{n}_{s}" for n in (5, 25, 50) for s in ("mean", "std", "kurt", "zscore", "entropy")]
NOM_RATIOS = [f"nom_value_w50_{s}_ratio" for s in ("std", "kurt", "entropy")]
SET_B_SQL = f"""
SELECT event_id, {rounded_sql(SET_B)}, {rounded_sql([*NOM, *NOM_RATIOS])} FROM (
  SELECT *, {', '.join(f"{own_mean_sql(r.removesuffix('_ratio'))} AS {r}" for r in NOM_RATIOS)} FROM (
  {stats_sql(f'''SELECT *, value_trend_removed - season AS value_season_trend_removed,
    {own_mean_sql('value')} AS value_ratio,
    {', '.join(f"{own_mean_sql(f'value_w50_{s}')} AS value_w50_{s}_ratio" for s in B_STATS)}
    FROM ({season_sql(TREND, 'value_trend_removed')})''', col='value_season_trend_removed', prefix='nom_')}))"""


# --- normalisation, smoothing, seasons -------------------------------------------------------


def _normalised(percentile):
    return lambda spark, sf: _ids(normalize.by_percentile(_ev(spark, sf), USER, percentile), "value")


def _normalised_sql(p):
    return f"""SELECT event_id, round(value / nullif(quantile_cont(value, {p}::DOUBLE) OVER (PARTITION BY user_id), 0), 6) AS value FROM events"""


def smoothed(spark, sf):
    return _ids(features.smooth(_ev(spark, sf), TYPE, 3.0, "smooth"), "smooth")


def smooth_sql(sigma: float) -> str:
    """event_id, event_type, ts, pos, smooth: mirrored Gaussian smoothing by position."""
    r = int(4 * sigma + 0.5)
    return f"""
SELECT p.event_id, p.event_type, p.ts, p.pos, sum(q.value * g.k) AS smooth
FROM (SELECT *, {POS_SQL} AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM ({EV})) p
CROSS JOIN (SELECT d, exp(-0.5 * (d / {sigma}::DOUBLE) ** 2) / sum(exp(-0.5 * (d / {sigma}::DOUBLE) ** 2)) OVER () AS k
            FROM range(-{r}, {r} + 1) t(d)) g
JOIN (SELECT event_type, value, {POS_SQL} AS pos FROM ({EV})) q
  ON q.event_type = p.event_type
 AND q.pos = CASE WHEN p.pos + g.d < 0 THEN -(p.pos + g.d) - 1 WHEN p.pos + g.d >= p.n THEN 2 * p.n - 1 - (p.pos + g.d) ELSE p.pos + g.d END
GROUP BY ALL"""


def peak_distance(spark, sf):
    rows = _ev(spark, sf)
    stats = series_stats(rows, TYPE.series)
    rows = features.smooth(rows, TYPE, 10.0, "smooth", stats=stats)
    spec = type(TYPE)(TYPE.series, TYPE.order, "smooth")
    return features.with_peak_distance(rows, spec, stats=stats).select("event_id", "rows_since_peak")


PEAK_SQL = f"""
SELECT event_id, CAST(coalesce(pos - last_value(CASE WHEN smooth > before AND smooth > after THEN pos END IGNORE NULLS)
    OVER (PARTITION BY event_type ORDER BY pos), -1) AS BIGINT) AS rows_since_peak
FROM (SELECT *, lag(smooth) OVER (PARTITION BY event_type ORDER BY pos) AS before,
             lead(smooth) OVER (PARTITION BY event_type ORDER BY pos) AS after FROM ({smooth_sql(10.0)}))"""


def autocorrelation(spark, sf):
    return rounded(seasonal.autocorrelation(_ev(spark, sf), TYPE))


ACF_SQL = f"""
SELECT event_type, CAST(l.lag AS INTEGER) AS lag, round_even(list_inner_product(x[1:n - l.lag], x[l.lag + 1:n]) / (v * (n - l.lag)), 6) AS r
FROM (SELECT event_type, list(value - m ORDER BY ts, event_id) AS x, any_value(v) AS v, count(*) AS n FROM (
        SELECT *, avg(value) OVER (PARTITION BY event_type) AS m, var_samp(value) OVER (PARTITION BY event_type) AS v FROM ({EV})) GROUP BY event_type) s
JOIN (SELECT unnest(range(1, (SELECT count(*) FROM events) + 1)) AS lag) l ON l.lag <= CAST(ceil(n / 2.0) AS BIGINT) - 1"""


def period(spark, sf):
    return rounded(seasonal.period(_ev(spark, sf), TYPE).select("event_type", "lag", "r", F.col("period").isNotNull().alias("found")))


PERIOD_SQL = f"""
SELECT event_type, arg_max(lag, abs(r)) AS lag, arg_max(r, abs(r)) AS r,
       max(abs(r)) > 0.5 AND arg_max(lag, abs(r)) > 1 AS found FROM ({ACF_SQL}) GROUP BY event_type"""


def _frames(n, fn, name, digits=6):
    return lambda spark, sf: rounded(
        features.rolling_apply(_ev(spark, sf), TYPE, n, fn, name).select("event_id", name), digits
    )


FRAME50 = f"(SELECT event_id, value, CASE WHEN count(value) OVER {frame_sql(50)} = 50 THEN list(value) OVER {frame_sql(50)} END AS f FROM ({EV}))"

AC_RESIDUAL_SQL = f"""
SELECT event_id, round(CASE WHEN f IS NULL THEN NULL WHEN abs(r) > 0.5 AND lag > 5 THEN f[50] - f[50 - lag] ELSE f[50] END, 6) AS residual
FROM {FRAME50} LEFT JOIN (
  SELECT event_id, arg_max(lag, abs(r)) AS lag, arg_max(r, abs(r)) AS r FROM (
    SELECT event_id, lag, list_inner_product(c[1:50 - lag], c[lag + 1:50]) / (50 - lag) / v AS r
    FROM (SELECT event_id, [x - list_avg(f) FOR x IN f] AS c, list_var_samp(f) AS v FROM {FRAME50} WHERE f IS NOT NULL),
         range(1, 25) t(lag)) GROUP BY event_id) USING (event_id)"""

WASSERSTEIN_SQL = f"""
SELECT event_id, round(list_sum([abs(i / 50.0::DOUBLE - len([x FOR x IN f[41:50] IF x <= s[i]]) / 10.0::DOUBLE) * (s[i + 1] - s[i]) FOR i IN range(1, 50)]), 6) AS wasserstein
FROM (SELECT event_id, f, list_sort(f) AS s FROM {FRAME50})"""


SEASON_RATIO_SQL = f"""
SELECT event_id, round(CASE WHEN wave IS NULL THEN NULL WHEN abs(list_median(wave)) <= 1e-9 * list_max([abs(x) FOR x IN wave]) THEN 10000
                            ELSE wave[50] / list_median(wave) END, 4) AS season_ratio
FROM events LEFT JOIN (
  SELECT event_id, [(c * cos(2 * pi() * j * t / 50) + s * sin(2 * pi() * j * t / 50)) / 50 FOR t IN range(50)] AS wave FROM (
    SELECT event_id, arg_max(j, c * c + s * s) AS j, arg_max(c, c * c + s * s) AS c, arg_max(s, c * c + s * s) AS s FROM (
      SELECT event_id, j, list_inner_product(f, cl) AS c, list_inner_product(f, sl) AS s FROM {FRAME50},
        (SELECT j, [cos(2 * pi() * j * t / 50) FOR t IN range(50)] AS cl, [sin(2 * pi() * j * t / 50) FOR t IN range(50)] AS sl FROM range(1, 26) b(j)) basis
      WHERE f IS NOT NULL) GROUP BY event_id)) USING (event_id)"""


def decomposed(spark, sf):
    return _ids(seasonal.decompose(_ev(spark, sf), TYPE, 12), "trend", "seasonal", "residual")


_P = "(SELECT event_id, event_type, value, pos, pos % 12 AS phase, CASE WHEN count(value) OVER g = 13 THEN (sum(value) OVER g - (lag(value, 6) OVER o + lead(value, 6) OVER o) / 2) / 12 END AS trend FROM (SELECT *, " + POS_SQL + f" AS pos FROM ({EV})) WINDOW o AS (PARTITION BY event_type ORDER BY pos), g AS (PARTITION BY event_type ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING))"
DECOMPOSE_SQL = f"""
WITH t AS {_P}, ph AS (SELECT event_type, phase, avg(value - trend) AS a FROM t GROUP BY ALL),
s AS (SELECT event_type, phase, a - avg(a) OVER (PARTITION BY event_type) AS seasonal FROM ph)
SELECT event_id, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(value - trend - seasonal, 6) AS residual
FROM t JOIN s USING (event_type, phase)"""


def deseasoned(spark, sf):
    return _ids(seasonal.remove_seasonality(_ev(spark, sf), TYPE), "value")


def spectrum(spark, sf):
    rows = seasonal.strongest_bins(seasonal.spectrum(_ev(spark, sf), TYPE), TYPE, 3)
    return rows.select("event_type", "rank", "bin", "period", F.round("power", 2).alias("power"))


SPECTRUM = f"""
SELECT event_type, CAST(k AS INTEGER) AS bin, any_value(n) // k AS period, any_value(n) AS n,
       sum(value * cos(2 * pi() * ((k * pos) % n) / n)) AS re, sum(value * sin(2 * pi() * ((k * pos) % n) / n)) AS im
FROM (SELECT event_type, value, {POS_SQL} AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM ({EV}))
JOIN (SELECT unnest(range(1, (SELECT count(*) FROM events) + 1)) AS k) b ON 2 * k <= n
GROUP BY event_type, k"""
SPECTRUM_SQL = f"""
SELECT event_type, CAST(rank AS INTEGER) AS rank, bin, period, round(re * re + im * im, 2) AS power
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY re * re + im * im DESC) AS rank FROM ({SPECTRUM})) WHERE rank <= 3"""


def bins_removed(spark, sf):
    rows = _ev(spark, sf)
    bins = seasonal.strongest_bins(seasonal.spectrum(rows, TYPE), TYPE, 1)
    return _ids(seasonal.remove_bins(rows, TYPE, bins), "filtered")


BINS_REMOVED_SQL = f"""
SELECT event_id, round(value - 2.0 / e.n * (re * cos(2 * pi() * ((bin * pos) % e.n) / e.n) + im * sin(2 * pi() * ((bin * pos) % e.n) / e.n)), 6) AS filtered
FROM (SELECT *, {POS_SQL} AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM ({EV})) e
JOIN (SELECT event_type, arg_max(bin, re * re + im * im) AS bin, arg_max(re, re * re + im * im) AS re,
             arg_max(im, re * re + im * im) AS im FROM ({SPECTRUM}) GROUP BY event_type) USING (event_type)"""


def full_spectrum(spark, sf):
    rows = seasonal.strongest_bins(seasonal.spectrum(_ev(spark, sf), USER), USER, 2)
    return rows.select("user_id", F.col("rank").cast("long").alias("rank"), F.col("bin").cast("long").alias("bin"), "period", F.round("power", 1).alias("power"))


FULL_SPECTRUM_SQL = f"""
SELECT user_id, rank, bin, n // bin AS period, round(power, 1) AS power FROM (
  SELECT user_id, k AS bin, any_value(n) AS n, sum(value * cos(2 * pi() * ((k * pos) % n) / n)) ** 2 + sum(value * sin(2 * pi() * ((k * pos) % n) / n)) ** 2 AS power,
         row_number() OVER (PARTITION BY user_id ORDER BY sum(value * cos(2 * pi() * ((k * pos) % n) / n)) ** 2 + sum(value * sin(2 * pi() * ((k * pos) % n) / n)) ** 2 DESC) AS rank
  FROM (SELECT user_id, value, row_number() OVER {order_sql('user_id')} - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM ({EV}))
  JOIN (SELECT unnest(range(1, (SELECT count(*) FROM events) + 1)) AS k) ON k <= n // 2
  GROUP BY user_id, k) WHERE rank <= 2"""


# --- windows with labels ---------------------------------------------------------------------


def _history(name, **kw):
    def build(spark, sf):
        rows = labelled(spark, sf).select("event_id", "event_type", "ts", "value", "is_anomaly")
        rows = embedding.history_windows(rows, TYPE, **kw)
        if kw.get("label_steps"):
            rows = rows.withColumn("label", F.array_join(F.transform("label", lambda x: x.cast("string")), ","))
        return rows.select(
            "event_id", F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 6).alias("window_sum"),
            F.get("window", F.lit(0)).alias("first"), F.element_at("window", -1).alias("last"), "label",
        )

    return build


def _history_sql(history, label, extra, step=1):
    f = f"(PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {history} PRECEDING AND 1 PRECEDING)"
    thin = "w" if step == 1 else f"[w[i + 1] FOR i IN range(len(w)) IF i % {step} = 0]"
    return f"""
SELECT event_id, round(list_sum(w2), 6) AS window_sum, w2[1] AS first, w2[len(w2)] AS last, label FROM (
  SELECT *, {thin} AS w2 FROM (
  SELECT event_id, list(value) OVER {f} AS w, {POS_SQL} AS pos, count(*) OVER (PARTITION BY event_type) AS n, {label} AS label
  FROM ({LABELLED_SQL})) WHERE pos >= {history} AND {extra} AND label IS NOT NULL)"""


def matrix_windows(spark, sf):
    rows = tagged_events(spark, sf).withColumn("is_anomaly", F.when(F.col("value") > 120, 1).otherwise(0))
    rows = embedding.matrix_windows(rows, TYPE, ["value", "k"], 5, "is_anomaly")
    rows = embedding.flat(rows)
    return rows.select(
        "event_id", F.size("vector").cast("long").alias("dims"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.get("vector", F.lit(9)).alias("last"), "window_label",
    )


_FW = "(PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)"
MATRIX_SQL = f"""
SELECT event_id, 10::BIGINT AS dims, round(total, 6) AS total, last, window_label FROM (
  SELECT event_id, {POS_SQL} AS pos, count(*) OVER (PARTITION BY event_type) AS n, sum(value + k) OVER {_FW} AS total,
         CAST(lead(k, 4) OVER {order_sql()} AS DOUBLE) AS last, max(CASE WHEN value > 120 THEN 1 ELSE 0 END) OVER {_FW} AS window_label
  FROM ({TAGGED_SQL})) WHERE pos < n - 5"""


def adjusted(spark, sf):
    return tolerance.adjust_predictions(labelled(spark, sf), TYPE, "is_anomaly", "predicted").select("event_id", "adjusted")


def adjusted_concatenated(spark, sf):
    return tolerance.adjust_predictions(labelled(spark, sf), ALL, "is_anomaly", "predicted").select("event_id", "adjusted")


def adjust_sql(part: str = "PARTITION BY event_type", source: str = LABELLED_SQL) -> str:
    f = f"({part} ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)"
    return f"""
SELECT *, CASE WHEN pos >= 5 AND predicted = 1 AND is_anomaly = 0 AND ya > 0 THEN 0
               WHEN pos >= 5 AND predicted = 0 AND is_anomaly = 1 AND pa > 0 THEN 1 ELSE predicted END AS adjusted
FROM (SELECT *, row_number() OVER ({part} ORDER BY ts, event_id) - 1 AS pos, max(is_anomaly) OVER {f} AS ya, max(predicted) OVER {f} AS pa
      FROM ({source}))"""


def batch_labels(spark, sf):
    return tolerance.batch_labels(labelled(spark, sf), USER, "is_anomaly").select("event_id", "batch_label")


BATCH_SQL = f"""
SELECT event_id, CASE WHEN row_number() OVER {order_sql('user_id')} > 20 AND max(is_anomaly) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) > 0 THEN 1 ELSE 0 END AS batch_label
FROM ({LABELLED_SQL})"""


def separator(spark, sf):
    rows = over_series(
        _ev(spark, sf), USER, lambda r, w: r.withColumn("separator", F.when(F.lead("event_id").over(w).isNull(), 1).otherwise(0)), after=1
    )
    return rows.select("event_id", "separator")


def global_index(spark, sf):
    return ordered.with_global_index(_ev(spark, sf), USER).select("event_id", "idx")


def merged_metrics(spark, sf):
    ev = tagged_events(spark, sf)
    app = ev.where(F.col("event_type").isin("click", "view")).select(F.col("ts").alias("datetime"), "event_id", F.col("value").alias("throughput"))
    stats = ev.where(F.col("event_type") == "error").select(
        F.col("ts").alias("datetime"), F.col("value").alias("cpu_usage"), F.col("k").cast("double").alias("memory_usage")
    )
    return rounded(resample.merge_metrics(app, stats, ["throughput"], ["cpu_usage", "memory_usage"], ["event_id"], 600))


def _round_sql(ts: str, seconds: int) -> str:
    us, unit = f"epoch_us({ts})", seconds * 1_000_000
    return (
        f"make_timestamp(CASE WHEN ({us} % {unit}) * 2 > {unit} OR (({us} % {unit}) * 2 = {unit} AND ({us} // {unit}) % 2 = 1) "
        f"THEN ({us} // {unit} + 1) * {unit} ELSE ({us} // {unit}) * {unit} END)"
    )


def _filled_sql(c: str) -> str:
    back = "(ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "(ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    t = f"CASE WHEN {c} IS NOT NULL THEN epoch_us(datetime) END"
    bt, at = f"last_value({t} IGNORE NULLS) OVER {back}", f"first_value({t} IGNORE NULLS) OVER {ahead}"
    bv, av = f"last_value({c} IGNORE NULLS) OVER {back}", f"first_value({c} IGNORE NULLS) OVER {ahead}"
    share = f"(epoch_us(datetime) - {bt}) / nullif({at} - {bt}, 0)"
    return f"round(coalesce({c}, {bv} + ({av} - {bv}) * {share}, {bv}, 0), 6) AS {c}"


MERGE_SQL = f"""
WITH e AS ({TAGGED_SQL}),
a AS (SELECT datetime, arg_min(value, (ts, event_id)) AS throughput FROM (SELECT *, {_round_sql('ts', 600)} AS datetime FROM e WHERE event_type IN ('click', 'view')) GROUP BY datetime),
s AS (SELECT {_round_sql('ts', 600)} AS datetime, avg(value) AS cpu_usage_mean, avg(k) AS memory_usage_mean FROM e WHERE event_type = 'error' GROUP BY 1),
m AS (SELECT * FROM a FULL JOIN s USING (datetime))
SELECT datetime, {_filled_sql('throughput')}, {_filled_sql('cpu_usage_mean')}, {_filled_sql('memory_usage_mean')} FROM m"""


def rounded_times(spark, sf):
    return events(spark, sf).select("event_id", resample.round_time(F.col("ts")).alias("datetime"))


def resampled_means(spark, sf):
    ev = tagged_events(spark, sf).withColumn("datetime", resample.round_time(F.col("ts"), 3600))
    return rounded(resample.mean_by_time(ev.withColumn("k", F.col("k").cast("double")), ["value", "k"], keys=["event_type"]))


RESAMPLED_SQL = f"SELECT event_type, {_round_sql('ts', 3600)} AS datetime, round(avg(value), 6) AS value_mean, round(avg(k), 6) AS k_mean FROM ({TAGGED_SQL}) GROUP BY ALL"


def first_per_user_day(spark, sf):
    rows = events(spark, sf).withColumn("day", F.to_date("ts")).select("user_id", "day", "ts", "event_id", "value")
    return resample.first_per_key(rows, ["user_id", "day"], ["ts", "event_id"]).select("user_id", "day", "event_id", "value")


def standardised(spark, sf):
    rows = _ev(spark, sf)
    train, test = rows.where(F.col("ts") < "2024-01-20"), rows.where(F.col("ts") >= "2024-01-20")
    a, b = normalize.standardise(train, [test], ["value"])
    return _ids(a.unionByName(b), "value")


STANDARD_SQL = """
SELECT event_id, round((value - m) / nullif(s, 0), 6) AS value FROM events,
  (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-20')"""


_msk, _msk_sql = _stats_query(MSK, True, True)
_zs, _zs_sql = _stats_query(ZS, True, True)
_zu, _zu_sql = _stats_query(MSK + ZS, True, True, USER)
_ent, _ent_sql = _stats_query(ENT, True, True)
_plain, _plain_sql = _stats_query(MSK + ZS, False, False)

QUERIES = [
    Query("flagged_series", flagged_series, FLAGGED_SQL),
    Query("lag_zero_fill", lag_zero_fill, LAG_SQL),
    Query("differences_signed", lambda s, d: _differences(s, d, lambda c: c), _differences_sql("")),
    Query("differences_absolute", lambda s, d: _differences(s, d, F.abs), _differences_sql("abs")),
    Query("long_differences", long_differences, LONG_DIFF_SQL),
    Query("rolling_stats_fallback", _msk, _msk_sql),
    Query("rolling_stats_short_series", _zu, _zu_sql),
    Query("rolling_zscore_fallback", _zs, _zs_sql),
    Query("rolling_entropy_fallback", _ent, _ent_sql),
    Query("rolling_stats_plain", _plain, _plain_sql),
    Query("lag_ratios", lag_ratios, LAG_RATIO_SQL),
    Query("step_ratios", step_ratios, STEP_RATIO_SQL),
    Query("own_mean_ratio", own_mean_ratio, f"SELECT event_id, round({own_mean_sql('value', 'user_id')}, 6) AS value_ratio FROM events"),
    Query("trend_removed", trend_removed, f"SELECT event_id, round(value_trend_removed, 6) AS trend_removed FROM ({TREND})"),
    Query("seasonal_component", seasonal_component, SEASON_SQL),
    Query("feature_set_lags", lambda s, d: _ids(features.lag_features(_ev(s, d), TYPE), *SET_A), SET_A_SQL),
    Query(
        "feature_set_seasonal",
        lambda s, d: _ids(features.seasonal_features(_ev(s, d), TYPE), *SET_B, *NOM, *NOM_RATIOS), SET_B_SQL,
    ),
    Query("feature_set_cluster", lambda s, d: _ids(features.cluster_features(_ev(s, d), TYPE), *SET_C, *C_RATIOS), SET_C_SQL),
    Query("normalise_p90", _normalised(90.0), _normalised_sql(0.9)),
    Query("normalise_p99", _normalised(99.0), _normalised_sql(0.99)),
    Query(
        "normalise_given_scale", lambda s, d: _ids(normalize.by_percentile(_ev(s, d), USER, scale=40.0), "value"),
        "SELECT event_id, round(value / 40.0::DOUBLE, 6) AS value FROM events",
    ),
    Query("gaussian_smooth", smoothed, f"SELECT event_id, round(smooth, 6) AS smooth FROM ({smooth_sql(3.0)})"),
    Query("peak_distance", peak_distance, PEAK_SQL),
    Query("autocorrelation", autocorrelation, ACF_SQL),
    Query("autocorrelation_period", period, PERIOD_SQL),
    Query("autocorrelation_residual", _frames(50, sp.autocorrelation_residual, "residual"), AC_RESIDUAL_SQL),
    Query("window_wasserstein", _frames(50, sp.tail_wasserstein, "wasserstein"), WASSERSTEIN_SQL),
    Query("seasonal_ratio", _frames(50, sp.seasonal_ratio, "season_ratio", 4), SEASON_RATIO_SQL),
    Query("seasonal_decompose", decomposed, DECOMPOSE_SQL),
    Query("remove_seasonality", deseasoned),
    Query("strongest_frequencies", spectrum, SPECTRUM_SQL),
    Query("remove_strongest_frequency", bins_removed, BINS_REMOVED_SQL),
    Query("full_spectrum_short_series", full_spectrum, FULL_SPECTRUM_SQL),
    Query(
        "history_windows_target", _history("t", history=20, target="is_anomaly", label_offset=0, target_steps=1),
        _history_sql(20, "is_anomaly", "pos < n - 1"),
    ),
    Query(
        "history_windows_own_value", _history("v", history=12, label_offset=3, target_steps=3),
        _history_sql(12, f"lead(value, 3) OVER {order_sql()}", "pos < n - 3"),
    ),
    Query(
        "history_windows_previous_label", _history("p", history=10, target="is_anomaly", label_offset=-1, target_steps=1),
        _history_sql(10, f"lag(is_anomaly, 1) OVER {order_sql()}", "pos < n - 1"),
    ),
    Query(
        "history_windows_stride", _history("s", history=24, target="is_anomaly", label_offset=0, target_steps=4, step=6, label_steps=4),
        _history_sql(
            24, "array_to_string(list(is_anomaly) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), ',')",
            "pos < n - 4", 6,
        ),
    ),
    Query("matrix_windows", matrix_windows, MATRIX_SQL),
    Query("tolerant_adjustment", adjusted, f"SELECT event_id, adjusted FROM ({adjust_sql()})"),
    Query("tolerant_adjustment_concatenated", adjusted_concatenated, f"SELECT event_id, adjusted FROM ({adjust_sql('')})"),
    Query("batch_labels", batch_labels, BATCH_SQL),
    Query("round_to_ten_seconds", rounded_times, f"SELECT event_id, {_round_sql('ts', 10)} AS datetime FROM events"),
    Query("resampled_means", resampled_means, RESAMPLED_SQL),
    Query("merge_resample_interpolate", merged_metrics, MERGE_SQL),
    Query(
        "keep_first_per_key", first_per_user_day,
        "SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY ALL",
    ),
    Query(
        "separator_flag", separator,
        f"SELECT event_id, CASE WHEN lead(event_id) OVER {order_sql('user_id')} IS NULL THEN 1 ELSE 0 END AS separator FROM events",
    ),
    Query("global_row_index", global_index, "SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS idx FROM events"),
    Query("standardise_by_train", standardised, STANDARD_SQL),
]
