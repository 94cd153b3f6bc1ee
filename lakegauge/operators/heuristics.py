"""Name- and shape-based dimension scores for tables nobody described.

Each column is judged by the rates at which its cells look like an e-mail, a
date, a number or a key; one aggregate per chunk of columns yields all rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakegauge import constants as C
from lakegauge.functions import cells, scoring
from lakegauge.operators.profile import quoted
from lakegauge.operators.uniqueness import row_uniqueness

# Columns per aggregate. The date and number tests make long code, and the JVM leaves
# methods beyond 8000 bytes uncompiled; each aggregate reads only its own columns.
CHUNK = 3


def _has(name: str, tokens) -> bool:
    return any(t in name for t in tokens)


def _rates(field: T.StructField, ordinal: int) -> Column:
    c, dt, name = quoted(field.name), field.dataType, field.name
    kind = cells.kind_of(dt)
    value = cells.present(c, dt)
    there = F.count(value)
    zero = F.lit(0).cast("bigint")
    boolean = isinstance(dt, T.BooleanType)
    text = cells.as_text(c, dt)
    when = cells.parse_datetime(c, dt, day_first=True)
    # a typed column needs no parsing to be judged
    if kind == "numeric":
        date, number, digit = zero, zero if boolean else there, zero if boolean else there
    elif kind == "temporal":
        date, number, digit = there, zero, there
    else:
        date = F.count(when) if kind == "text" else zero
        number = F.count_if(cells.is_ptbr_number(text))
        digit = F.count_if(text.rlike(r"\p{Nd}"))
    email = F.count_if(cells.is_email(text)) if _has(name, (C.EMAIL_TOKEN,)) else zero
    alnum = F.count_if(cells.matches_stripped(text, C.ALNUM_PATTERN.strip("^$"))) if _has(name, C.ID_TOKENS) else zero
    latest = cells.epoch_seconds(F.max(when)) if _has(name, C.DATE_TOKENS) else F.lit(None).cast("double")
    filled = F.count_if(cells.not_blank(text)) if kind in ("text", "nested") else there
    return F.struct(
        F.lit(ordinal).alias("ordinal"), F.lit(name).alias("column_name"),
        F.count(F.lit(1)).alias("total"), there.alias("present"),
        email.alias("email"), date.alias("date"), number.alias("number"), digit.alias("digit"),
        alnum.alias("alnum"), filled.alias("filled"), latest.cast("double").alias("latest"),
        F.lit(_has(name, (C.EMAIL_TOKEN,))).alias("email_named"), F.lit(_has(name, C.DATE_TOKENS)).alias("date_named"),
        F.lit(_has(name, C.ID_TOKENS)).alias("id_named"),
    )


def heuristic_rates(df: DataFrame) -> DataFrame:
    """One row per column: how many cells are present and look like what."""
    fields = df.schema.fields
    out = None
    for at in range(0, len(fields), CHUNK):
        structs = [_rates(f, at + i) for i, f in enumerate(fields[at:at + CHUNK])]
        part = df.agg(F.array(*structs).alias("r")).select(F.inline("r"))
        out = part if out is None else out.unionAll(part)
    return out


def _share(part: str) -> Column:
    return F.col(part) / F.nullif(F.col("present"), F.lit(0))


def column_verdicts(rates: DataFrame) -> DataFrame:
    """Per column: validity parts (sum and number), dominant share, integrity share, date share."""
    there = F.col("present") > 0
    email_part = F.when(F.col("email_named") & there, _share("email"))
    date_part = F.when(F.col("date_named") & there, _share("date"))
    number_part = F.when(there & (_share("digit") >= 0.8), _share("number"))
    parts = [email_part, date_part, number_part]
    chosen = (F.when(F.col("email_named") & (_share("email") > 0.5), _share("email"))
              .when(_share("date") > 0.7, _share("date"))
              .when(_share("number") > 0.7, _share("number"))
              .otherwise(_share("filled")))
    zero = F.lit(0.0)
    return rates.withColumns({
        "validity_sum": sum((F.coalesce(p, zero) for p in parts[1:]), F.coalesce(parts[0], zero)),
        "validity_parts": sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int")),
        "dominant": F.when(there, F.greatest(chosen, 1 - chosen)),
        "integrity": F.when(F.col("id_named") & there,
                            0.7 * F.col("present") / F.col("total") + 0.3 * _share("alnum")),
        "date_share": date_part,
    })


def heuristic_scores(df: DataFrame, as_of, sla_hours: float = C.SLA_HOURS) -> DataFrame:
    """The six heuristic dimensions (two decimals) and the final note of one table.

    `as_of` is the moment against which freshness is measured (a timestamp literal
    or a datetime without zone); it is a parameter so that a run can be repeated.
    """
    v = column_verdicts(heuristic_rates(df))
    now = cells.epoch_seconds(cells.moment(as_of))
    best = F.max_by("latest", F.when(F.col("date_share") >= 0.7, F.struct("date_share", -F.col("ordinal"))))
    share = F.sum("validity_sum") / F.nullif(F.sum("validity_parts"), F.lit(0))
    judged = v.agg(
        F.max("total").alias("total"),
        scoring.score10(F.avg(F.col("present") / F.nullif(F.col("total"), F.lit(0)))).alias("completude"),
        F.lit(None).cast("double").alias("unicidade"),
        scoring.score10(F.coalesce(share, F.lit(1.0))).alias("validade"),
        scoring.score10(F.coalesce(F.avg("dominant"), F.lit(1.0))).alias("consistencia"),
        scoring.score10(F.coalesce(F.avg("integrity"), F.lit(1.0))).alias("integridade"),
        scoring.score10(1 - (now - best) / 3600.0 / sla_hours).alias("freshness"),
    )
    rows = row_uniqueness(df, as_joined_text=True).select(
        F.col("total"), *[(F.col("score") if d == "unicidade" else F.lit(None).cast("double")).alias(d)
                          for d in C.DIMENSIONS])
    merged = judged.unionByName(rows).agg(
        F.max("total").alias("total_registros"), *[F.max(d).alias(d) for d in C.DIMENSIONS])
    filled = F.col("total_registros") > 0
    rounded = merged.withColumns({d: F.when(filled, scoring.exact_round(F.col(d), 2)).otherwise(0.0) for d in C.DIMENSIONS})
    return rounded.withColumn("nota_final", scoring.overall_score("star", 2))
