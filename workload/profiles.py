"""Profiles, distinct counts, uniqueness and preparation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lakegauge import constants as C
from lakegauge.functions import cells, scoring
from lakegauge.operators import profile as prof
from lakegauge.operators import uniqueness as uniq
from lakegauge.sources import prepare
from workload.registry import load, query, rounded
from workload.tables import cte, order_texts, orders_dirty

# Datasets that the profile queries measure: name -> (column, Spark type), in table order.
DATASETS = {
    "orders_dirty": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderdate", "timestamp_ntz"),
                     ("customer_id", "bigint"), ("vl_total", "double"), ("status", "string"),
                     ("dt_pedido", "timestamp_ntz"), ("dt_entrega", "timestamp_ntz"), ("email", "string"),
                     ("valor_txt", "string"), ("data_txt", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
}
# The other tables of the folder; with the above, all of it.
TABLES = {n: c for n, c in DATASETS.items() if n != "orders_dirty"} | {
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
               ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
}
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"


def datasets(spark, sf_dir, names=tuple(DATASETS)):
    return {n: orders_dirty(spark, sf_dir) if n == "orders_dirty" else load(spark, sf_dir, n) for n in names}


def profiles(spark, sf_dir, names=tuple(DATASETS), **options) -> DataFrame:
    return prof.profiles([({"dataset": F.lit(n)}, df) for n, df in datasets(spark, sf_dir, names).items()], **options)


# --- datetime and number texts in SQL -----------------------------------------------

def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


# Datetime shapes of the test tables: (shape, patterns tried in order; in the other order when the day comes first).
DATETIME_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ("yyyy-M-d",)),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", ("yyyy-M-d H:m:s",)),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", ("yyyy-M-d H:m:s.SSSSSS",)),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", ("yyyy-M-d'T'H:m:s",)),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("M/d/yyyy", "d/M/yyyy")),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", ("M/d/yyyy H:m:s", "d/M/yyyy H:m:s")),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ("yyyy/M/d",)),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("M-d-yyyy", "d-M-yyyy")),
)

_STRPTIME = {
    "yyyy-M-d": "%Y-%m-%d", "yyyy-M-d H:m:s": "%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s.SSSSSS": "%Y-%m-%d %H:%M:%S.%f",
    "yyyy-M-d'T'H:m:s": "%Y-%m-%dT%H:%M:%S", "M/d/yyyy": "%m/%d/%Y", "d/M/yyyy": "%d/%m/%Y",
    "M/d/yyyy H:m:s": "%m/%d/%Y %H:%M:%S", "d/M/yyyy H:m:s": "%d/%m/%Y %H:%M:%S", "yyyy/M/d": "%Y/%m/%d",
    "M-d-yyyy": "%m-%d-%Y", "d-M-yyyy": "%d-%m-%Y",
}


def parse_dt(x: str, day_first: bool = False) -> str:
    whens = []
    for shape, patterns in DATETIME_SHAPES:
        tried = reversed(patterns) if day_first else patterns
        calls = ", ".join(f"try_strptime({strip(x)}, '{_STRPTIME[p]}')" for p in tried)
        whens.append(f"WHEN regexp_matches({strip(x)}, '{shape}') THEN coalesce({calls})")
    return "CASE " + " ".join(whens) + " END"


_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def float_of(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_FLOAT}') THEN try_cast({x} AS DOUBLE) END"


def ptbr_plain(x: str) -> str:
    return f"replace(replace({strip(f'replace({strip(x)}, chr(37), chr(0))')}, '.', ''), ',', '.')".replace(
        "chr(0)", "''").replace("chr(37)", "'%'")


# --- profile in SQL --------------------------------------------------------------------

def column_sql(dataset: str, i: int, name: str, dtype: str) -> str:
    numeric, temporal = dtype in ("bigint", "int", "double"), dtype == "timestamp_ntz"
    kind = "numeric" if numeric else "temporal" if temporal else "text"
    typed = numeric or temporal
    dated = not typed and any(t in name for t in ("date", "data", "dt_", "_dt", "timestamp", "created", "updated"))
    parts = [
        f"'{dataset}' AS dataset", f"{i}::INTEGER AS ordinal", f"'{name}' AS column_name", f"'{dtype}' AS dtype",
        f"'{kind}' AS kind", "count(*) AS total", f"count(*) - count({name}) AS nulls",
        f"count(DISTINCT {name}) AS distinct_cnt",
        f"min({name})::VARCHAR AS min_value" if typed else "NULL::VARCHAR AS min_value",
        f"max({name})::VARCHAR AS max_value" if typed else "NULL::VARCHAR AS max_value",
        "NULL::DOUBLE AS avg_len" if typed else f"avg(length({name})) AS avg_len",
        "NULL::BIGINT AS max_len" if typed else f"max(length({name})) AS max_len",
        "NULL::BIGINT AS non_blank" if typed else f"count(*) FILTER (WHERE {strip(name)} <> '') AS non_blank",
        f"count({parse_dt(name)}) AS parse_ok" if dated else "NULL::BIGINT AS parse_ok",
    ]
    return f"SELECT {', '.join(parts)} FROM {dataset}"


def profile_cte(names=tuple(DATASETS)) -> str:
    rows = " UNION ALL ".join(column_sql(d, i, c, t) for d in names for i, (c, t) in enumerate(DATASETS[d]))
    return (f"SELECT *, coalesce(nulls / nullif(total, 0), 0)::DOUBLE AS null_rate, "
            f"coalesce(distinct_cnt / nullif(total - nulls, 0), 0)::DOUBLE AS distinct_ratio FROM ({rows})")


def profile_sql(body: str, names=tuple(DATASETS), **extra: str) -> str:
    return cte(body, *(["orders_dirty"] if "orders_dirty" in names else []), p=profile_cte(names), **extra)


FULL = ("dataset, ordinal, column_name, dtype, kind, total, nulls, round(null_rate, 6) AS null_rate, distinct_cnt, "
         "round(distinct_ratio, 6) AS distinct_ratio, min_value, max_value, round(avg_len, 6) AS avg_len, max_len, "
         "non_blank, parse_ok")


@query("column_profile", profile_sql(f"SELECT {FULL} FROM p"))
def column_profile(spark, sf_dir):
    return rounded(profiles(spark, sf_dir)).drop("type_count")


@query("column_null_metrics", profile_sql(
    "SELECT dataset, column_name, total, nulls, round(null_rate, 6) AS null_rate FROM p"))
def column_null_metrics(spark, sf_dir):
    return rounded(profiles(spark, sf_dir, distinct="none").select(
        "dataset", "column_name", "total", "nulls", "null_rate"))


@query("column_distinct_metrics", profile_sql(
    "SELECT dataset, column_name, distinct_cnt, round(distinct_ratio, 6) AS distinct_ratio FROM p"))
def column_distinct_metrics(spark, sf_dir):
    return rounded(profiles(spark, sf_dir).select("dataset", "column_name", "distinct_cnt", "distinct_ratio"))


@query("column_distinct_approx", profile_sql(
    "SELECT dataset, column_name, total - nulls AS present, distinct_cnt, TRUE AS within_bound FROM p"))
def column_distinct_approx(spark, sf_dir):
    """HyperLogLog beside the exact count; the sketch's error must stay within five standard errors of it."""
    keys = ["dataset", "column_name"]
    approx = profiles(spark, sf_dir, distinct="approx").select(
        *keys, (F.col("total") - F.col("nulls")).alias("present"), F.col("distinct_cnt").alias("approx"))
    exact = profiles(spark, sf_dir).select(*keys, "distinct_cnt")
    near = F.abs(F.col("approx") - F.col("distinct_cnt")) <= F.greatest(F.lit(1.0), 0.1 * F.col("distinct_cnt"))
    return approx.join(exact, keys).select(*keys, "present", "distinct_cnt", near.alias("within_bound"))


@query("column_min_max", profile_sql(
    "SELECT dataset, column_name, min_value, max_value FROM p WHERE kind <> 'text'"))
def column_min_max(spark, sf_dir):
    return profiles(spark, sf_dir, distinct="none").where(F.col("kind") != "text").select(
        "dataset", "column_name", "min_value", "max_value")


@query("column_text_lengths", profile_sql(
    "SELECT dataset, column_name, round(avg_len, 6) AS avg_len, max_len FROM p WHERE kind = 'text'"))
def column_text_lengths(spark, sf_dir):
    return rounded(profiles(spark, sf_dir, distinct="none").where(F.col("kind") == "text").select(
        "dataset", "column_name", "avg_len", "max_len"))


@query("nested_profile", """
    SELECT 'embedding' AS column_name, count(*) AS total, count(*) - count(embedding) AS nulls,
      count(DISTINCT embedding) AS distinct_cnt FROM embeddings""")
def nested_profile(spark, sf_dir):
    return prof.profile(load(spark, sf_dir, "embeddings").select("embedding")).select(
        "column_name", "total", "nulls", "distinct_cnt")


@query("table_metrics", profile_sql("""
    SELECT dataset, max(total) AS sample_rows, count(*) AS columns, sum(nulls)::BIGINT AS null_cells,
      sum(total)::BIGINT AS total_cells, round(coalesce(sum(nulls) / nullif(sum(total), 0), 0), 6) AS null_rate,
      round(avg(1 - null_rate), 6) AS mean_fill_rate
    FROM p GROUP BY dataset"""))
def table_metrics(spark, sf_dir):
    return rounded(prof.table_metrics(profiles(spark, sf_dir, distinct="none"), "dataset"))


@query("avg_distinct_ratio", profile_sql(
    "SELECT dataset, round(avg(distinct_ratio), 6) AS avg_distinct_ratio FROM p GROUP BY dataset"))
def avg_distinct_ratio(spark, sf_dir):
    return rounded(prof.avg_distinct_ratio(profiles(spark, sf_dir), "dataset"))


_ROW = "coalesce(text, '') || '|' || coalesce(lang, '') || '|' || coalesce(source, '') || '|' || n_chars::VARCHAR"
_DUP = """SELECT '{form}' AS form, count(*) AS total, count(DISTINCT {row}) AS distinct_rows,
    round(1 - count(DISTINCT {row}) / count(*), 6) AS dup_rate,
    round(10 * count(DISTINCT {row}) / count(*), 6) AS score FROM documents"""


@query("row_uniqueness", _DUP.format(form="struct", row="(text, lang, source, n_chars)")
       + " UNION ALL " + _DUP.format(form="text", row=f"({_ROW})")
       + " UNION ALL " + _DUP.format(form="whole", row="(doc_id, text, lang, source, n_chars)")
       + " UNION ALL " + _DUP.format(form="whole text", row=f"(doc_id::VARCHAR || '|' || {_ROW})"))
def row_uniqueness(spark, sf_dir):
    """Whole rows, and rows without their id, so that there are copies to be found."""
    whole = load(spark, sf_dir, "documents")
    content = whole.select("text", "lang", "source", "n_chars")
    forms = [uniq.row_uniqueness(df, as_text).withColumn("form", F.lit(form)) for form, df, as_text in (
        ("struct", content, False), ("text", content, True), ("whole", whole, False), ("whole text", whole, True))]
    return rounded(reduce(DataFrame.unionByName, forms))


_KEY = """SELECT '{t}' AS dataset, count(*) AS total, count(DISTINCT {k}) FILTER (WHERE {nn}) AS distinct_keys,
    round(10 * (count(DISTINCT {k}) FILTER (WHERE {nn})) / count(*), 6) AS score FROM {t}"""


@query("key_uniqueness", cte(
    _KEY.format(t="lineitem", k="(l_orderkey, l_linenumber)", nn="TRUE") + " UNION ALL "
    + _KEY.format(t="orders_dirty", k="(customer_id, status)", nn="customer_id IS NOT NULL AND status IS NOT NULL"),
    "orders_dirty"))
def key_uniqueness(spark, sf_dir):
    line = uniq.key_uniqueness(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    orders = uniq.key_uniqueness(orders_dirty(spark, sf_dir), ["customer_id", "status"])
    return rounded(line.withColumn("dataset", F.lit("lineitem")).unionByName(
        orders.withColumn("dataset", F.lit("orders_dirty"))))


_REQUIRED = ("customer_id", "vl_total", "status", "dt_pedido", "email")
_MEAN_NULL = "(" + " + ".join(f"(count(*) - count({c}))" for c in _REQUIRED) + f") / count(*) / {len(_REQUIRED)}"


@query("required_completeness", cte(
    f"SELECT count(*) AS total, round({_MEAN_NULL}, 6) AS mean_null_rate, "
    f"round(10 * (1 - {_MEAN_NULL}), 6) AS score FROM orders_dirty", "orders_dirty"))
def required_completeness(spark, sf_dir):
    return rounded(uniq.required_completeness(orders_dirty(spark, sf_dir), _REQUIRED))


@query("simple_table_score", cte(
    f"""SELECT count(*) AS total, round(10 * (1 - {_MEAN_NULL}), 6) AS completude,
      round(10 * count(DISTINCT customer_id) / count(*), 6) AS unicidade,
      round((10 * (1 - {_MEAN_NULL}) + 10 * count(DISTINCT customer_id) / count(*)) / 2, 2) AS nota_final
    FROM orders_dirty""", "orders_dirty"))
def simple_table_score(spark, sf_dir):
    return rounded(uniq.simple_table_score(orders_dirty(spark, sf_dir), ["customer_id"], _REQUIRED))


# --- preparation -------------------------------------------------------------------------

@query("drop_empty_rows", cte(
    """SELECT status, email, dt_entrega FROM orders_dirty
       WHERE status IS NOT NULL OR email IS NOT NULL OR dt_entrega IS NOT NULL""", "orders_dirty"))
def drop_empty_rows(spark, sf_dir):
    return prepare.drop_empty_rows(orders_dirty(spark, sf_dir).select("status", "email", "dt_entrega"))


def _sanitize_sql(x: str, empty: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({strip(x)}), '\\s+', '_', 'g'), '[^a-z0-9_]', '', 'g')"
    named = f"coalesce(nullif({plain}, ''), '{empty}')"
    return f"CASE WHEN regexp_matches({named}, '^[0-9]') THEN 's_' || {named} ELSE {named} END"


@query("sanitize_names", cte(
    f"""SELECT name_mix, {_sanitize_sql('name_mix', 'obj')} AS as_object, {_sanitize_sql('name_mix', 'col')} AS as_column,
      count(*) AS n FROM order_texts GROUP BY ALL""", "order_texts"))
def sanitize_names(spark, sf_dir):
    name = F.col("name_mix")
    return order_texts(spark, sf_dir).groupBy(
        "name_mix", cells.sanitize_expr(name, "obj").alias("as_object"),
        cells.sanitize_expr(name, "col").alias("as_column")).agg(F.count(F.lit(1)).alias("n"))


def _part(i: int) -> str:
    if i < 4:
        return f"CASE WHEN len(s) >= {i} THEN s[{i}] END"
    return "CASE WHEN len(s) >= 4 THEN array_to_string(s[4:], ',') END"


_PASTED_CTES = {
    "lines": "SELECT string_split(line, ',') AS s FROM order_texts WHERE line IS NOT NULL",
    "parts": f"SELECT {strip(_part(1))} AS unidade, {strip(_part(2))} AS produto, {strip(_part(3))} AS tipo, "
             f"{strip(_part(4))} AS valor_raw FROM lines",
}


def ptbr(x: str) -> str:
    return f"CASE WHEN ends_with({strip(x)}, '%') THEN ({float_of(ptbr_plain(x))}) / 100 ELSE {float_of(ptbr_plain(x))} END"


@query("split_pasted_csv", cte(
    f"""SELECT unidade, produto, tipo, valor_raw, round({ptbr('valor_raw')}, 6) AS valor,
      (SELECT avg(CASE WHEN length(line) - length(replace(line, ',', '')) >= 3 THEN 1.0 ELSE 0.0 END) >= 0.6
       FROM order_texts WHERE line IS NOT NULL) AS pasted FROM parts""", "order_texts", **_PASTED_CTES))
def split_pasted_csv(spark, sf_dir):
    lines = order_texts(spark, sf_dir).select("line")
    pasted = prof.looks_like_pasted_csv(lines).first().pasted
    return rounded(prepare.unpasted(lines)).withColumn("pasted", F.lit(pasted))


@query("parse_ptbr_number", cte(
    f"""SELECT o_orderkey, number_mix, round({ptbr('number_mix')}, 6) AS valor,
      {float_of(ptbr_plain('number_mix'))} IS NOT NULL AS is_number FROM order_texts WHERE number_mix IS NOT NULL""",
    "order_texts"))
def parse_ptbr_number(spark, sf_dir):
    text = F.col("number_mix")
    return rounded(order_texts(spark, sf_dir).where(text.isNotNull()).select(
        "o_orderkey", "number_mix", cells.parse_ptbr_number(text).alias("valor"),
        cells.is_ptbr_number(text).alias("is_number")))


@query("parse_datetime", cte(
    f"""SELECT o_orderkey, dt_mix, {parse_dt('dt_mix')} AS month_first, {parse_dt('dt_mix', True)} AS day_first
    FROM order_texts""", "order_texts"))
def parse_datetime(spark, sf_dir):
    text = F.col("dt_mix")
    return order_texts(spark, sf_dir).select(
        "o_orderkey", "dt_mix", cells.parse_datetime(text).alias("month_first"),
        cells.parse_datetime(text, day_first=True).alias("day_first"))


@query("clamp_scores", """
    SELECT c_custkey, CASE WHEN c_acctbal / 500 < 0 THEN 0.0::DOUBLE WHEN c_acctbal / 500 > 10 THEN 10.0::DOUBLE
      ELSE round(c_acctbal / 500, 6) END AS score FROM customer""")
def clamp_scores(spark, sf_dir):
    return rounded(load(spark, sf_dir, "customer").select(
        "c_custkey", scoring.clamp10(F.col("c_acctbal") / 500).alias("score")))
