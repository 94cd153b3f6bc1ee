"""Clean-up of freshly read tables: empty rows, column names, pasted CSV lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lakegauge.functions import cells
from lakegauge.operators.profile import looks_like_pasted_csv, quoted

PASTED_NAMES = ("unidade", "produto", "tipo", "valor_raw")
PLAIN_NAMES = ("col1", "col2", "col3", "col4")


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def sanitize_name(name: str, empty: str = "obj") -> str:
    """Identifier form of a name: lower case, blanks to _, only a-z, 0-9 and _."""
    kept = re.sub("[^a-z0-9_]", "", "_".join(str(name).strip().lower().split())) or empty
    return f"s_{kept}" if kept[0].isdigit() else kept


def sanitize_columns(df: DataFrame, empty: str = "col") -> DataFrame:
    """Sanitised column names; a name that is taken gets _2, _3 and so on."""
    taken: set[str] = set()
    names = []
    for column in df.columns:
        base = name = sanitize_name(column, empty)
        n = 2
        while name in taken:
            name, n = f"{base}_{n}", n + 1
        taken.add(name)
        names.append(name)
    return df.toDF(*names)


def split_pasted_csv(df: DataFrame, names: Sequence[str] = PASTED_NAMES) -> DataFrame:
    """The one column of lines as four columns; what follows the third comma stays together.

    With the material names the texts are trimmed and the last one is also read
    as a number. Lines that are null are left out.
    """
    line = quoted(df.columns[0]).cast("string")
    parts = df.where(line.isNotNull()).select(F.split(line, ",", 4).alias("p"))
    texts = [F.get("p", F.lit(i)) for i in range(4)]
    if tuple(names) != PASTED_NAMES:
        return parts.select(*[t.alias(n) for t, n in zip(texts, names)])
    out = parts.select(*[cells.strip(t).alias(n) for t, n in zip(texts, names)])
    return out.withColumn("valor", cells.parse_ptbr_number(F.col("valor_raw")))


def unpasted(df: DataFrame, names: Sequence[str] = PASTED_NAMES) -> DataFrame:
    """Splits the table if it is a column of pasted CSV lines, else returns it as it is."""
    if len(df.columns) == 1 and looks_like_pasted_csv(df).first().pasted:
        return split_pasted_csv(df, names)
    return df
