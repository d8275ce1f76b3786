"""Validation rules V1 to V7 as columns over quote lines.

A rule takes the lines' columns and gives new values of fields, whether it flags the line, and its findings.
All rules run in one projection chain; later ones see what earlier ones have parsed. Findings are an array
column until the end, so that validating never shuffles; the supplier check and the snippet checks join the
files' raw texts by source_file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Defaults of the settings that the rules read.
AMOUNT_TOLERANCE = 0.02
#: Standard units and their other names, matched without regard to case.
UNITS = {
    "件": ["件", "个", "只", "支", "pcs", "PC"], "台": ["台"], "套": ["套", "set", "sets"], "条": ["条"], "根": ["根"], "箱": ["箱"], "袋": ["袋"], "卷": ["卷"],
    "米": ["米", "m"], "公斤": ["公斤", "千克", "kg"], "升": ["升", "L", "l"],
}
FINDINGS = "array<struct<rule_ord:int,part:int,rule:string,message:string>>"


@dataclass
class Outcome:
    """values: new columns by name; flag: condition or None; findings: (condition, message) in order.

    before: steps of helper columns, made one after the other, for what is costly and used more than once.
    """

    before: list[dict[str, Column]] = field(default_factory=list)
    values: dict[str, Column] = field(default_factory=dict)
    flag: Column | None = None
    findings: list[tuple[Column, Column]] = field(default_factory=list)


def reverse_units(units: dict[str, list[str]] = UNITS) -> dict[str, str]:
    return {name.strip().lower(): std.strip() for std, names in units.items() for name in (std, *names)}


def required(options: dict) -> Outcome:
    name, price = T.is_blank(F.col("item_name")), T.is_blank(F.col("unit_price_raw"))
    missing = F.array_compact(F.array(F.when(name, "物料名称"), F.when(price, "单价")))
    return Outcome(flag=name | price, findings=[(name | price, F.concat(F.lit("必填字段缺失: "), F.array_join(missing, "、")))])


def numbers(options: dict) -> Outcome:
    out, flags = Outcome(before=[{}, {}]), []
    for raw, target, label in (("quantity_raw", "quantity", "数量"), ("unit_price_raw", "unit_price", "单价")):
        text, value = F.col(f"_{target}_text"), F.col(f"_{target}")
        out.before[0][f"_{target}_text"] = T.strip(F.coalesce(F.col(raw), F.lit("")))
        out.before[1][f"_{target}"] = T.parse_number(text)
        there = text != ""
        odd, bad = there & T.ocr_confusion(text), there & value.isNull()
        out.findings += [
            (odd, F.concat(F.lit(f"{label}疑似 OCR 字符混淆（0/O、1/I/l），解析值需人工核对: "), T.quoted(text))),
            (bad, F.concat(F.lit(f"{label}无法解析为数值（保留原文）: "), T.quoted(text))),
        ]
        flags.append(odd | bad)
        out.values[target] = F.coalesce(value, F.col(target))
    out.flag = flags[0] | flags[1]
    return out


def amounts(options: dict) -> Outcome:
    text, amount, calc = F.col("_amount_text"), F.col("_amount"), F.col("_calc")
    due = (text != "") & F.col("quantity").isNotNull() & F.col("unit_price").isNotNull()
    off = F.when(amount == 0, calc != 0).otherwise(F.abs(calc - amount) > F.lit(float(options.get("amount_tolerance", AMOUNT_TOLERANCE))) * F.abs(amount))
    before = [
        {"_amount_text": T.strip(F.coalesce(F.col("amount_raw"), F.lit(""))), "_calc": F.col("quantity") * F.col("unit_price")},
        {"_amount": T.parse_number(text)},
        {"_unread": due & amount.isNull(), "_off": F.coalesce(due & off, F.lit(False))},
    ]
    message = F.concat(
        F.lit("金额不符: "), T.general(F.col("quantity")), F.lit("×"), T.general(F.col("unit_price")), F.lit("="), T.general(calc), F.lit(" ≠ 报价金额 "), T.general(amount), F.lit("（差额 "), T.signed(calc - amount), F.lit("）")
    )
    unread = F.col("_unread")
    return Outcome(before, flag=unread | F.col("_off"), findings=[(unread, F.concat(F.lit("金额无法解析为数值（保留原文）: "), T.quoted(text))), (F.col("_off"), message)])


def currency_and_tax(options: dict) -> Outcome:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = F.col("_currency")
    before = [{"_currency": T.detect_currency(F.concat_ws(" ", blank("unit_price_raw"), blank("amount_raw"), blank("remark")))}]
    other = found.isNotNull() & ~found.eqNullSafe(F.col("currency"))
    tax = T.detect_tax(F.concat_ws(" ", blank("remark"), blank("unit_price_raw"), blank("source_snippet")))
    message = F.concat(F.lit("原文币种疑似 "), found, F.lit("，与标记 "), blank("currency"), F.lit(" 不一致（已改为 "), found, F.lit("，未做换算）"))
    return Outcome(before, {"currency": F.coalesce(found, F.col("currency")), "tax_included": F.coalesce(F.col("tax_included"), tax)}, None, [(other, message)])


def lead_times(options: dict) -> Outcome:
    text, days = F.col("_lead_text"), F.col("_lead_days")
    bad = (text != "") & days.isNull()
    found = T.lead_numbers(F.col("_lead_term"))
    before = [{"_lead_text": T.strip(F.coalesce(F.col("lead_time_raw"), F.lit("")))}, {"_lead_term": T.lead_term(text)}, {f"_lead_{k}": c for k, c in found.items()}]
    before.append({"_lead_days": T.term_days(text, {k: F.col(f"_lead_{k}") for k in found})})
    return Outcome(before, {"lead_time_days": F.coalesce(days, F.col("lead_time_days"))}, bad, [(bad, F.concat(F.lit("交期无法解析为天数（保留原文）: "), T.quoted(text)))])


def unit_names(options: dict) -> Outcome:
    known = F.create_map(*[F.lit(x) for kv in reverse_units(options.get("units", UNITS)).items() for x in kv])
    return Outcome(values={"unit": F.coalesce(F.try_element_at(known, F.lower(T.strip(F.col("unit")))), F.col("unit"))})


#: The rules in their order; findings carry the place in it. Extend by adding a (name, function) pair.
RULES: tuple[tuple[str, Callable[[dict], Outcome]], ...] = (
    ("V1", required), ("V2", numbers), ("V3", amounts), ("V4", currency_and_tax), ("V5", lead_times), ("V6", unit_names),
)


def apply_rules(lines: DataFrame, options: dict | None = None, rules=RULES) -> DataFrame:
    """Lines with parsed fields, flags and `line_findings`: the findings of each line in the order of the rules."""
    rows = lines.withColumn("line_findings", F.array().cast(FINDINGS))
    for n, (name, rule) in enumerate(rules, 1):
        out = rule(options or {})
        for step in out.before:
            rows = rows.withColumns(step)
        new = dict(out.values)
        if out.flag is not None:
            new["flags"] = F.when(out.flag, F.array_union(F.coalesce("flags", F.array().cast("array<string>")), F.array(F.lit(name)))).otherwise(F.col("flags"))
        if out.findings:
            found = [F.when(when, F.struct(F.lit(n).alias("rule_ord"), F.lit(k).alias("part"), F.lit(name).alias("rule"), message.alias("message"))) for k, (when, message) in enumerate(out.findings)]
            new["line_findings"] = F.concat("line_findings", F.array_compact(F.array(*found)).cast(FINDINGS))
        rows = rows.withColumns(new).drop(*[c for step in out.before for c in step])
    return rows


def supplier_names(raw: DataFrame) -> DataFrame:
    """(source_file, names): sorted company names of files that name several. A name that another one holds, or that holds another, doesn't count."""
    names = F.array_distinct(F.regexp_extract_all("raw_text", F.lit(T.COMPANY), F.lit(0)))
    alone = lambda n: ~F.exists("all_names", lambda m: (m != n) & (F.contains(m, n) | F.contains(n, m)))
    rows = raw.select("source_file", names.alias("all_names"))
    return rows.select("source_file", F.array_sort(F.filter("all_names", alone)).alias("names")).filter(F.size("names") > 1)


def supplier_findings(raw: DataFrame) -> DataFrame:
    """V7 of whole files: source_file, rule_ord, line_no (null), target, rule, message."""
    message = F.concat(F.lit("同一文件出现多个供应商名称: "), F.array_join("names", "、"), F.lit("，整个文件标黄待人工确认"))
    return supplier_names(raw).select("source_file", F.lit(len(RULES) + 1).alias("rule_ord"), F.lit(None).cast("int").alias("line_no"), F.lit(0).alias("part"), F.col("source_file").alias("target"), F.lit("V7").alias("rule"), message.alias("message"))


def flag_suppliers(lines: DataFrame, raw: DataFrame) -> DataFrame:
    """Lines with V7 among their flags where their file names several suppliers."""
    several = supplier_names(raw).select("source_file", F.lit(True).alias("_several"))
    rows = lines.join(several, "source_file", "left")
    return rows.withColumn("flags", F.when(F.col("_several"), F.array_union("flags", F.array(F.lit("V7")))).otherwise(F.col("flags"))).drop("_several")


def findings(checked: DataFrame) -> DataFrame:
    """The line findings as rows: source_file, rule_ord, line_no, part, target, rule, message."""
    # an explode() would bring along a filter on the array's size, in which all rules are made once more below the projections
    rows = checked.select("source_file", "line_no", F.explode_outer("line_findings").alias("f")).filter("f.rule is not null")
    return rows.select("source_file", "f.rule_ord", "line_no", "f.part", F.concat("source_file", F.lit("#行"), F.col("line_no").cast("string")).alias("target"), "f.rule", "f.message")


def check_snippets(lines: DataFrame, raw: DataFrame) -> DataFrame:
    """Lines held against their files' texts: confidence low and flag H1 where the snippet isn't found, OCR where it lies on a line that was read badly."""
    low = F.filter(F.transform(F.coalesce("low_ocr_lines", F.array().cast("array<string>")), T.provenance), lambda x: x != "")
    texts = raw.select("source_file", T.provenance(F.col("raw_text")).alias("_text"), low.alias("_low"))
    rows = lines.join(texts, "source_file", "left").withColumn("_snippet", T.provenance(F.col("source_snippet")))
    lost = (F.coalesce("source_snippet", F.lit("")) == "") | ~F.contains(F.coalesce("_text", F.lit("")), F.col("_snippet"))
    poor = (F.col("_snippet") != "") & F.coalesce(F.exists("_low", lambda x: F.contains(x, F.col("_snippet")) | F.contains(F.col("_snippet"), x)), F.lit(False))
    flags = F.array_union(F.array_union(F.coalesce("flags", F.array().cast("array<string>")), F.when(lost, F.array(F.lit("H1"))).otherwise(F.array().cast("array<string>"))), F.when(poor, F.array(F.lit("OCR"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumns({"h1": lost, "ocr_low": poor, "confidence": F.when(lost | poor, "low").otherwise(F.col("confidence")), "flags": flags})
    return rows.drop("_text", "_low", "_snippet")
