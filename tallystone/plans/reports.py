"""Projections and counts of the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed texts.
FAILED_MARK, UNSUPPORTED_MARK = "LLM_FAILED", "不支持"


def pivot_suppliers(entries: DataFrame, suppliers: Sequence[str], group: str = "item_key") -> DataFrame:
    """One row for each group with price and days of the listed suppliers, as s0_price, s0_lead, ..."""
    of = lambda c, s: F.max(F.when(F.col("supplier_name") == s, F.col(c)))
    return entries.groupBy(group).agg(*[of(c, s).alias(f"s{i}_{name}") for i, s in enumerate(suppliers) for c, name in (("unit_price", "price"), ("lead_time_days", "lead"))])


def detail(lines: DataFrame) -> DataFrame:
    """The long table of all lines: tax as a word, flags joined, yellow for low confidence or any flag."""
    tax = F.when(F.col("tax_included").isNull(), "").when(F.col("tax_included"), "含税").otherwise("未税")
    yellow = (F.col("confidence") == "low") | (F.size("flags") > 0)
    names = ("source_file", "line_no", "supplier_name", "item_name", "spec", "quantity_raw", "quantity", "unit", "unit_price_raw", "unit_price", "amount_raw", "currency")
    return lines.select(*names, tax.alias("tax"), "lead_time_raw", "lead_time_days", "payment_terms", "remark", "confidence", F.array_join("flags", ",").alias("flags"), "source_snippet", yellow.alias("yellow"))


def failed(warnings: str) -> Column:
    return F.exists(warnings, lambda w: F.startswith(w, F.lit(FAILED_MARK)))


def file_stats(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """source_file, kind, supplier_name, n_lines, n_warnings, status."""
    n = lines.groupBy("source_file").agg(F.count("*").alias("n_lines"))
    status = F.when(failed("warnings"), "失败").when(F.size("warnings") > 0, "警告").otherwise("正常")
    rows = quotes.join(n, "source_file", "left")
    return rows.select("source_file", "kind", "supplier_name", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size("warnings").alias("n_warnings"), status.alias("status"))


def failures(files: DataFrame, quotes: DataFrame) -> DataFrame:
    """(file, reason) of unsupported and of failed files."""
    unsupported = files.filter("kind = 'unsupported'").select(F.col("source_file").alias("file"), F.concat(F.lit("不支持的格式: "), "detail").alias("reason"))
    lost = quotes.filter(failed("warnings")).select(F.col("source_file").alias("file"), F.lit("LLM 解析失败（原文见 解析失败原文 Sheet）").alias("reason"))
    return unsupported.unionByName(lost)


def summary(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: n_files, n_lines, n_failed, n_with_lines."""
    s = file_stats(quotes, lines)
    return s.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"), F.count_if(F.col("status") == "失败").alias("n_failed"), F.count_if(F.col("n_lines") > 0).alias("n_with_lines"))


def accuracy(pairs: DataFrame, *by: str) -> DataFrame:
    """Of rows (expected, actual, flagged): n_fields, n_wrong_unflagged and accuracy, by groups or over all."""
    wrong = ~F.col("expected").eqNullSafe(F.col("actual")) & ~F.col("flagged")
    rows = pairs.groupBy(*by).agg(F.count("*").alias("n_fields"), F.count_if(wrong).alias("n_wrong_unflagged"))
    return rows.withColumn("accuracy", 1 - F.col("n_wrong_unflagged") / F.col("n_fields"))
