"""Checks of a DataFrame against its declared schema: report, strict gate, valid/quarantine split."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from meterfold.fixed_values import QUALITY_TEXT
from meterfold.sources.schemas import schema_of

REPORT = "table_name string, column_name string, rule string, n_violations bigint, example string"


class SchemaViolation(ValueError):
    """Raised by the strict gate with every violated rule in its message."""


@dataclass(frozen=True)
class Check:
    column: str
    rule: str
    broken: Column
    detail: object = None


def _is_null(df: DataFrame, name: str) -> Column:
    null = F.col(name).isNull()
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        null = null | F.isnan(name)
    return null


def row_checks(df: DataFrame, table: str) -> list[Check]:
    """Every per-value rule that applies to the columns ``df`` has, in declaration order."""
    checks = []
    for field in schema_of(table):
        if field.name not in df.columns:
            continue
        null = _is_null(df, field.name)
        text = F.col(field.name).cast("string")
        if not field.nullable:
            checks.append(Check(field.name, "not_null", null))
        if isinstance(field.dataType, T.StringType):
            limit, allowed = field.metadata.get("max_length"), field.metadata.get("enum_values")
            if limit is not None:
                too_long = ~null & (F.char_length(text) > limit)
                checks.append(Check(field.name, "max_length", too_long, limit))
            if allowed is not None:
                checks.append(Check(field.name, "enum", ~null & ~text.isin(*allowed), allowed))
    return checks


def column_differences(df: DataFrame, table: str) -> tuple[list[str], list[str]]:
    """(missing, unexpected) column names."""
    expected = set(schema_of(table).fieldNames())
    return sorted(expected - set(df.columns)), sorted(set(df.columns) - expected)


def quality_report(df: DataFrame, table: str) -> DataFrame:
    """One row per broken rule: violation count and the smallest offending value.

    All rules are counted in one aggregation, so the table is read once and only one partial
    row per task is exchanged.
    """
    missing, extra = column_differences(df, table)

    def line(column, rule, count, example):
        return F.struct(
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
            F.lit(rule).alias("rule"), count.cast("bigint").alias("n_violations"),
            example.cast("string").alias("example"))

    def example_of(check):
        if check.rule == "not_null":
            return F.lit(None)
        return F.min(F.when(check.broken, F.col(check.column).cast("string")))

    none = F.lit(None)
    rows = [line(c, "missing", none, none) for c in missing]
    rows += [line(c, "extra", none, none) for c in extra]
    checks = row_checks(df, table)
    measured = {}
    for i, check in enumerate(checks):
        measured[f"n{i}"], measured[f"e{i}"] = F.count_if(check.broken), example_of(check)
        rows.append(line(check.column, check.rule, F.col(f"n{i}"), F.col(f"e{i}")))
    if not rows:
        return df.sparkSession.createDataFrame([], REPORT)
    counts = df.agg(F.count(F.lit(1)), *[c.alias(name) for name, c in measured.items()])
    report = counts.select(F.inline(F.array(*rows)))
    return report.where(F.col("n_violations").isNull() | (F.col("n_violations") > 0))


def violations(df: DataFrame, table: str) -> list[str]:
    """The report as messages (at most a few per declared column)."""
    missing, extra = column_differences(df, table)
    messages = []
    if missing:
        messages.append(QUALITY_TEXT["missing"].format(names=missing))
    if extra:
        messages.append(QUALITY_TEXT["extra"].format(names=extra))
    broken = {
        (r.column_name, r.rule): r
        for r in quality_report(df, table).where("n_violations is not null").collect()
    }
    for check in row_checks(df, table):
        row = broken.get((check.column, check.rule))
        if row is None:
            continue
        messages.append(QUALITY_TEXT[check.rule].format(
            column=check.column, n=row.n_violations, example=row.example,
            length=len(row.example or ""), limit=check.detail,
            choices=sorted(check.detail) if check.rule == "enum" else None,
        ))
    return messages


def require_valid(df: DataFrame, table: str) -> DataFrame:
    """Return ``df`` unchanged, or raise with all violations."""
    messages = violations(df, table)
    if messages:
        raise SchemaViolation(
            QUALITY_TEXT["failed"].format(table=table, errors="\n  - ".join(messages))
        )
    return df


def with_row_errors(df: DataFrame, table: str, name: str = "row_errors") -> DataFrame:
    """Add the list of broken ``column:rule`` pairs of each row."""
    labels = [F.when(c.broken, F.lit(f"{c.column}:{c.rule}")) for c in row_checks(df, table)]
    empty = F.array().cast("array<string>")
    return df.withColumn(name, F.array_compact(F.array(*labels)) if labels else empty)


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their ``row_errors``)."""
    marked = with_row_errors(df, table)
    valid = marked.where(F.size("row_errors") == 0).drop("row_errors")
    return valid, marked.where(F.size("row_errors") > 0)
