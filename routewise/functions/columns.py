"""Column expressions shared by the models.  All JVM-side built-ins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num, den, scale: int | None = None) -> Column:
    """``round(num::numeric / nullif(den, 0), n)`` as double.

    The division runs in decimal (exact to 10 places) like the numeric
    original: dividing an inexact double would turn a true tie such as
    100111.115 into 100111.11499999999 and round it the wrong way.  ANSI
    mode raises on division by zero, so the NULLIF is required."""
    den = col(den)
    q = col(num).cast("decimal(28,6)") / F.when(den != 0, den).cast("decimal(28,6)")
    return (F.round(q, scale) if scale is not None else q).cast("double")


def round_mean(c, scale: int) -> Column:
    """Postgres-like ``round(avg(x), n)``: exact ratio, then half-up, as double.
    Integer inputs average exactly in double; decimal inputs keep decimal."""
    return F.round(F.avg(col(c)), scale).cast("double")


def count_if(cond: Column) -> Column:
    """``count(*) FILTER (WHERE cond)``; NULL condition does not count."""
    return F.count(F.when(cond, 1))


def sum_if(c, cond: Column) -> Column:
    """``sum(x) FILTER (WHERE cond)``: NULL when no row qualifies."""
    return F.sum(F.when(cond, col(c)))


def is_in(c, values) -> Column:
    """CASE WHEN c IN (...) THEN true ELSE false: NULL maps to false."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def flag(cond: Column) -> Column:
    """CASE WHEN cond THEN true ELSE false END."""
    return F.coalesce(cond, F.lit(False))


def map_value(c, mapping: dict, default=None) -> Column:
    """CASE c WHEN k THEN v ... ELSE default END."""
    items = list(mapping.items())
    expr = F.when(col(c) == items[0][0], F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(col(c) == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def is_peak(period="time_period") -> Column:
    return is_in(period, K.PEAK_PERIODS)


def is_weekend(day="day_of_week") -> Column:
    return is_in(day, K.WEEKEND_DAYS)


def is_overcrowded(load="load_factor") -> Column:
    return flag(col(load) > K.OVERCROWDED_LOAD)


def period_of_hour(hour_col) -> Column:
    """Hour of day -> period bucket (6-9 AM peak, 9-17 midday, 17-20 PM peak)."""
    h = col(hour_col)
    (a0, a1, a), (m0, m1, m), (p0, p1, p) = K.PERIOD_HOURS
    return (F.when((h >= a0) & (h < a1), a).when((h >= m0) & (h < m1), m)
            .when((h >= p0) & (h < p1), p).otherwise("off_peak"))


def tiered_severity(wait="wait_time_min", transfers="transfers_required",
                    score="satisfaction_score") -> Column:
    """P10: 1.00 / 0.75 / 0.50 / 0.25 tiers."""
    w, t, s = col(wait), col(transfers), col(score)
    (c1, v1), (c2, v2), (c3, v3) = K.SEVERITY_TIERS
    return (F.when((w >= c1[0]) & (t >= c1[1]) & (s <= c1[2]), F.lit(v1))
            .when((w >= c2[0]) & (t >= c2[1]) & (s <= c2[2]), F.lit(v2))
            .when(w >= c3[0], F.lit(v3))
            .otherwise(F.lit(K.SEVERITY_DEFAULT)))


def weighted_severity(transfers="transfers_required", wait="wait_time_min",
                      score="satisfaction_score", travel="travel_time_min") -> Column:
    """0.35*transfers + 0.01*wait + 0.30*(6-score) + 0.005*travel, round 4,
    in exact decimal arithmetic like the numeric original."""
    w = K.SEVERITY_WEIGHTS
    d = lambda v: F.lit(v).cast("decimal(6,3)")
    expr = (col(transfers).cast("decimal(18,0)") * d(w["transfers"])
            + col(wait).cast("decimal(18,0)") * d(w["wait"])
            + (F.lit(6) - col(score)).cast("decimal(18,0)") * d(w["inv_score"])
            + col(travel).cast("decimal(18,0)") * d(w["travel"]))
    return F.round(expr, 4).cast("double")


def effect_label(d) -> Column:
    """|d| < 0.2 negligible, < 0.5 small, < 0.8 medium, else large."""
    a = F.abs(col(d))
    (c1, l1), (c2, l2), (c3, l3) = K.EFFECT_SIZE_CUTS
    return F.when(a < c1, l1).when(a < c2, l2).when(a < c3, l3).otherwise(K.EFFECT_SIZE_TOP)


def cluster_label(cid="cluster_id") -> Column:
    """Semantic label; unknown id -> 'Cluster <id>'."""
    return F.coalesce(map_value(cid, K.CLUSTER_LABELS),
                      F.concat(F.lit("Cluster "), col(cid).cast("string")))


def conj(conds) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def optional_isin(c, values) -> Column:
    """Empty / None selection means 'all'."""
    return F.lit(True) if not values else col(c).isin(list(values))


def zero_pad(prefix: str, num, width: int) -> Column:
    """``prefix + printf('%0<width>d', num)`` for non-negative integers with
    codegen'd string functions (``format_string`` is interpreted).  Longer
    numbers are kept whole (lpad alone would truncate them)."""
    s = col(num).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0")))


def weekday_name(d) -> Column:
    """Full English weekday name of a date/timestamp (``EEEE``) via an array
    lookup on ``dayofweek`` (1 = Sunday)."""
    names = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.dayofweek(col(d)))


def local_timestamp(tz: str = "Asia/Manila") -> Column:
    """P20 variant: the current time expressed in a local zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.current_timestamp().cast("timestamp_ntz"))


def score_color(score) -> Column:
    """Linear map of a 1-5 score to a red->green hex colour."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col(score) - 1) / 4.0))
    r = F.round((1 - t) * 255).cast("int")
    g = F.round(t * 255).cast("int")
    return F.format_string("#%02x%02x40", r, g)
