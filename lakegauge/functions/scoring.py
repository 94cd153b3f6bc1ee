"""Scores, bands and texts computed from numbers. All Column -> Column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from lakegauge import constants as C
from lakegauge.functions import cells


def clamp10(c: Column) -> Column:
    """Into [0, 10]; null and NaN become 0 (least/greatest alone would turn NaN into 10)."""
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.nanvl(c.cast("double"), F.lit(0.0))))


def exact_round(c: Column, digits: int) -> Column:
    """Rounds the binary value itself, exact ties to even, as Python's round() does.

    F.round looks at the shortest decimal text instead and lifts every apparent tie.
    """
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits)).cast("double")


def score10(share: Column) -> Column:
    """A share in [0, 1] as a 0-10 score."""
    return clamp10(share * 10)


def steps(c: Column, bounds: Sequence[tuple], default, strict: bool = False) -> Column:
    """Value of the first bound reached, bounds given highest first."""
    hit = (lambda low: c > low) if strict else (lambda low: c >= low)
    (low, value), *rest = bounds
    return reduce(lambda chain, b: chain.when(hit(b[0]), b[1]), rest, F.when(hit(low), value)).otherwise(default)


def classify(score: Column, bands: str = "scan") -> Column:
    """Band name of a score; no band without a score, the lowest one for NaN."""
    return cells.let(score.try_cast("double"), lambda value: (
        F.when(value.isNull(), C.NO_BAND).when(F.isnan(value), C.LOWEST_BAND)
        .otherwise(steps(value, C.BANDS[bands], C.LOWEST_BAND))))


def weighted(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum of part x weight, added in the order of the weights."""
    terms = [parts[name] * F.lit(float(w)) for name, w in weights.items()]
    return reduce(lambda a, b: a + b, terms)


def overall_score(weights: str = "scan", digits: int = 4, columns: Mapping[str, str] | None = None) -> Column:
    """Weighted, clamped and rounded note over the six dimension columns."""
    names = columns or {d: d for d in C.DIMENSIONS}
    return exact_round(clamp10(weighted({d: F.col(n) for d, n in names.items()}, C.WEIGHTS[weights])), digits)


def volume_score(rows: Column) -> Column:
    return steps(rows, C.VOLUME_STEPS, C.VOLUME_MIN)


def rule_penalty(violations: Column, total: Column) -> Column:
    """0 without violations, else -2, -4 beyond 10 % and -6 beyond 30 % of the rows."""
    share = F.try_divide(violations, total)
    return F.when((total > 0) & (violations > 0), steps(share, C.PENALTY_STEPS, 0.0, strict=True)).otherwise(0.0)


def fmt_score(c: Column) -> Column:
    """Two decimals without trailing zeros; '-' for null."""
    text = F.regexp_replace(F.format_string("%.2f", exact_round(c, 2)), r"\.?0+$", "")
    return F.when(c.isNull(), "-").otherwise(text)


def threshold_advice(null_share: Column, duplicate_share: Column) -> Column:
    return (F.when(null_share > C.ADVICE_NULL_SHARE, C.ADVICE_NULLS)
            .when(duplicate_share > C.ADVICE_DUPLICATE_SHARE, C.ADVICE_DUPLICATES)
            .otherwise(C.ADVICE_NONE))


def priority_score(criticality: Column, impact: Column, severity: Column,
                   trend_penalty: Column | None = None, quick_win: Column | None = None) -> Column:
    zero = F.lit(0)
    return (criticality + impact + severity
            + (zero if trend_penalty is None else trend_penalty)
            + (zero if quick_win is None else quick_win))


def priority_band(score: Column) -> Column:
    return steps(score, C.PRIORITY_STEPS, C.PRIORITY_MIN)


def recommendation_theme(text: Column) -> Column:
    """Theme of a recommendation by the first keyword group found in it."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    groups = [(lowered.rlike("|".join(words)), theme) for theme, words in C.THEME_KEYWORDS]
    (cond, theme), *rest = groups
    return reduce(lambda chain, g: chain.when(*g), rest, F.when(cond, theme)).otherwise(C.THEME_DEFAULT)


def lookup(key: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """Constant mapping as an expression (for tables of a handful of entries)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def lowest_dimension(columns: Mapping[str, str] | None = None) -> Column:
    """Name of the lowest dimension in the row; ties go to the first name."""
    names = columns or {d: d for d in C.DIMENSIONS}
    pairs = [F.struct(F.col(c).cast("double").alias("score"), F.lit(d).alias("dimension")) for d, c in names.items()]
    return F.array_min(F.array(*pairs))["dimension"]
