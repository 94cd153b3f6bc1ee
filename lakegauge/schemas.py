"""Row layouts of the result tables, and alignment of any DataFrame to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


# Who was scanned, when, from where; stamped on every result row.
ENVELOPE = T.StructType(
    _fields(_S, "run_id") + _fields(_TS, "scanned_at")
    + _fields(_S, "source_type source source_name source_ref object_name dataset_name dataset "
                  "table_name file_name sheet_name"))
ENVELOPE_TEXTS = [f.name for f in ENVELOPE.fields if f.dataType == _S and f.name != "run_id"]

_DIMS = _fields(_D, "completude unicidade consistencia validade integridade freshness")

TABLE_METRICS = T.StructType(
    ENVELOPE.fields + _fields(_L, "sample_rows columns null_cells total_cells") + _fields(_D, "null_rate"))
COLUMN_METRICS = T.StructType(
    ENVELOPE.fields + _fields(_S, "column_name dtype") + _fields(_L, "total nulls") + _fields(_D, "null_rate")
    + _fields(_L, "distinct_cnt") + _fields(_D, "distinct_ratio") + _fields(_S, "min_value max_value")
    + _fields(_D, "avg_len") + _fields(_L, "max_len"))
TABLE_SCORES = T.StructType(
    ENVELOPE.fields + _fields(_L, "row_count column_count") + _fields(_D, "score")
    + _fields(_S, "classification") + _DIMS + _fields(_L, "dimension_count"))
COLUMN_SCORES = T.StructType(
    ENVELOPE.fields + _fields(_S, "column_name dtype") + _fields(_D, "score") + _fields(_S, "classification")
    + _DIMS + _fields(_L, "total nulls") + _fields(_D, "null_rate") + _fields(_L, "distinct_cnt")
    + _fields(_D, "distinct_ratio"))
RULE_RESULTS = T.StructType(
    ENVELOPE.fields + _fields(_S, "column_name rule_name rule_value") + _fields(_B, "passed")
    + _fields(_D, "rule_score") + _fields(_S, "details"))
RUN_LOG = T.StructType(
    _fields(_TS, "run_ts") + _fields(_S, "source_file file_hash table_name") + _fields(_L, "total_registros")
    + _fields(_D, "completude unicidade validade consistencia integridade freshness nota_final"))

# History tables.
RUN_HISTORY = T.StructType(
    _fields(_S, "run_id") + _fields(_TS, "run_timestamp") + _fields(_S, "source_schema")
    + _fields(_L, "datasets_count columns_scanned") + _fields(_D, "overall_score")
    + _fields(_S, "overall_classification report_excel_path report_html_path radar_html_path history_html_path"))
DATASET_HISTORY = T.StructType(
    _fields(_S, "run_id") + _fields(_TS, "run_timestamp")
    + _fields(_S, "dataset_name source_type source_ref object_name") + _fields(_D, "score_overall")
    + _fields(_S, "classification_overall")
    + _fields(_D, "score_completeness score_consistency score_uniqueness score_validity score_timeliness "
                  "score_integrity priority_index") + _fields(_L, "critical_columns_count"))
DIMENSION_HISTORY = T.StructType(
    _fields(_S, "run_id") + _fields(_TS, "run_timestamp") + _fields(_S, "dataset_name dimension_name")
    + _fields(_D, "dimension_score"))
RECOMMENDATIONS = T.StructType(
    _fields(_S, "recommendation_id run_id") + _fields(_TS, "run_timestamp")
    + _fields(_S, "dataset_name column_name recommendation_level recommendation_type root_cause_hypothesis "
                  "recommendation_text expected_benefit estimated_effort estimated_impact")
    + _fields(_D, "priority_score") + _fields(_S, "priority_band owner_suggestion implementation_hint"))


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of `schema` in its order and types: absent ones null, others dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
