"""The files of a run: the comparison workbook, the whole result as JSON, and a short report.

A workbook is for people and bounded by what a sheet holds, so its rows come to the driver one by one. The
result in full stays in tables; result_rows() makes its JSON without collecting.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare as C
from ..plans import reports as P
from ..plans.batch import Run
from .workbook import Cell, Sheet, column_name, write

#: Fixed texts: heads of the sheets.
DETAIL_HEAD = ("来源文件", "供应商", "物料名称", "规格型号", "数量(原文)", "数量", "单位", "单价(原文)", "单价", "金额(原文)", "币种", "含税", "交期(原文)", "交期(天)", "付款方式", "备注", "置信度", "标记", "原文片段")
SUPPLIER_HEAD, AUX_HEAD = ("单价", "数量", "交期", "置信度"), ("均价", "最低价", "最高价", "备注")
DETAIL_COLUMNS = ("source_file", "supplier_name", "item_name", "spec", "quantity_raw", "quantity", "unit", "unit_price_raw", "unit_price", "amount_raw", "currency", "tax", "lead_time_raw", "lead_time_days", "payment_terms", "remark", "confidence", "flags", "source_snippet")
SHEET_ROWS = 1_048_576


def _bold(values) -> list[Cell]:
    return [Cell(v, bold=True) for v in values]


def compare_sheet(run: Run, price_deviation: float = C.PRICE_DEVIATION, lead_factor: float = C.LEAD_FACTOR) -> Sheet:
    """One row for each group in its order, four cells for each supplier; gray where a supplier is missing."""
    suppliers = [r.supplier_name for r in run.suppliers.orderBy("supplier_ord").collect()]
    stats = run.groups.drop("review", "notes", "item_name", "spec", "group_ord")
    cells = C.coloured(run.entries, stats, price_deviation, lead_factor, "group_key").join(run.groups.select("group_key", "group_ord"), "group_key")

    def rows() -> Iterator[list]:
        yield _bold(["物料名称", "规格型号", *[s if i == 0 else None for s in suppliers for i in range(4)], *AUX_HEAD])
        yield _bold([None, None, *SUPPLIER_HEAD * len(suppliers)])
        entries = cells.orderBy("group_ord").toLocalIterator()
        held = next(entries, None)
        for g in run.groups.orderBy("group_ord").toLocalIterator():
            own = {}
            while held is not None and held.group_ord == g.group_ord:
                own[held.supplier_name] = held
                held = next(entries, None)
            row: list = [g.item_name, g.spec]
            for s in suppliers:
                e = own.get(s)
                if e is None:
                    fill = C.GRAY if len(own) >= 2 else None
                    row += [Cell("缺报" if fill else None, fill), *[Cell(None, fill)] * 3]
                    continue
                other = C.YELLOW if e.yellow else None
                row += [
                    Cell(e.unit_price_raw if e.unit_price is None else e.unit_price, e.price_color), Cell(e.quantity_raw if e.quantity is None else e.quantity, other),
                    Cell(e.lead_time_raw if e.lead_time_days is None else e.lead_time_days, e.lead_color), Cell(e.confidence + (f" ({','.join(e.flags)})" if e.flags else ""), other),
                ]
            yield row + [None if v is None else round(v, 4) for v in (g.avg_price, g.min_price, g.max_price)] + ["；".join(g.notes)]

    n = 2 + 4 * len(suppliers)
    joined = ["A1:A2", "B1:B2", *[f"{column_name(3 + 4 * i)}1:{column_name(6 + 4 * i)}1" for i in range(len(suppliers))], *[f"{column_name(n + j)}1:{column_name(n + j)}2" for j in range(1, 5)]]
    return Sheet("比价总表", rows(), [18, 16, *[10, 8, 8, 12] * len(suppliers), 10, 10, 10, 40], "C3", joined)


def detail_sheet(run: Run) -> Sheet:
    def rows() -> Iterator[list]:
        yield _bold(DETAIL_HEAD)
        for r in P.detail(run.lines).orderBy("source_file", "line_no").toLocalIterator():
            yield [Cell(r[c], C.YELLOW if r.yellow else None) for c in DETAIL_COLUMNS]

    return Sheet("明细数据", rows(), [16, 18, 16, 14, 10, 8, 6, 12, 8, 10, 6, 6, 10, 8, 12, 12, 8, 8, 40], "A2")


def stats_sheet(run: Run) -> Sheet:
    def block(title: str, head: tuple, rows: DataFrame, columns: tuple[str, ...]) -> Iterator[list]:
        yield [Cell(title, bold=True)]
        yield _bold(head)
        for r in rows.toLocalIterator():
            yield [r[c] for c in columns]
        yield []

    def rows() -> Iterator[list]:
        order = ("source_file", "rule_ord", "line_no", "part")
        yield from block("文件处理统计", ("文件", "类型", "供应商", "报价行数", "警告数", "状态"), P.file_stats(run.quotes, run.lines).orderBy("source_file"), ("source_file", "kind", "supplier_name", "n_lines", "n_warnings", "status"))
        yield from block("失败清单", ("文件", "原因"), run.failures.orderBy("file"), ("file", "reason"))
        yield from block("缺报清单", ("物料", "缺报供应商"), run.missing.orderBy("group_ord", "supplier_ord"), ("item", "supplier_name"))
        yield from block("金额不符清单（V3）", ("对象定位", "说明"), run.findings.filter("rule = 'V3'").orderBy(*order), ("target", "message"))
        yield from block("比价说明", ("说明",), run.notes.orderBy("kind", "o"), ("note",))
        yield from block("校验发现（V1~V7 / H1）", ("对象定位", "规则号", "说明"), run.findings.orderBy(*order), ("target", "rule", "message"))

    return Sheet("统计与异常", rows(), [28, 20, 60])


def failed_sheet(run: Run) -> Sheet:
    def rows() -> Iterator[list]:
        yield [Cell(v, C.YELLOW, True) for v in ("文件", "原始文本（未解析，请人工处理）")]
        lost = run.quotes.filter(P.failed("warnings")).select("source_file").join(run.raw, "source_file")
        for r in lost.orderBy("source_file").toLocalIterator():
            yield [Cell(r.source_file, C.YELLOW), Cell(r.raw_text, C.YELLOW)]

    return Sheet("解析失败原文", rows(), [24, 100])


def write_workbook(run: Run, out, price_deviation: float = C.PRICE_DEVIATION, lead_factor: float = C.LEAD_FACTOR) -> list[str]:
    """Writes the workbook and returns its sheets' names. ValueError if the lines don't fit a sheet."""
    if run.lines.count() >= SHEET_ROWS:
        raise ValueError("a sheet can't hold all lines; write the tables instead")
    sheets = [] if run.groups.isEmpty() else [compare_sheet(run, price_deviation, lead_factor)]
    sheets += [detail_sheet(run), stats_sheet(run)]
    if not run.quotes.filter(P.failed("warnings")).isEmpty():
        sheets.append(failed_sheet(run))
    write(out, sheets)
    return [s.title for s in sheets]


def result_rows(run: Run) -> DataFrame:
    """(kind, ord, json): all parts of the result as JSON rows: quotes with their lines, findings, groups with their entries, missing, notes, failed files."""
    as_json = lambda rows, kind, order: rows.select(F.lit(kind).alias("kind"), order.cast("string").alias("ord"), F.to_json(F.struct(*rows.columns)).alias("json"))
    lines = run.lines.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("line_no", *[c for c in run.lines.columns if c not in ("line_no", "source_file")]))).alias("lines"))
    parts = [(run.quotes.join(lines, "source_file", "left"), "quote", F.col("source_file")), (run.findings, "finding", F.col("source_file")), (run.missing, "missing", F.format_string("%09d", "group_ord")), (run.notes, "note", F.col("o")), (run.failures, "failed_file", F.col("file"))]
    off = C.coloured(run.entries, run.groups.drop("review", "notes", "item_name", "spec", "group_ord"), group="group_key")
    entries = off.groupBy("group_key").agg(F.sort_array(F.collect_list(F.struct("first_entry", "supplier_name", "source_file", "unit_price", "quantity", "lead_time_days", "confidence", "flags", "deviation", "price_color", "lead_color"))).alias("entries"))
    parts.append((run.groups.join(entries, "group_key"), "group", F.format_string("%09d", "group_ord")))
    out = as_json(*parts[0])
    for part in parts[1:]:
        out = out.unionByName(as_json(*part))
    return out


def result_json(run: Run) -> str:
    """The result of a run of moderate size as one JSON text."""
    out: dict[str, list] = defaultdict(list)
    for r in result_rows(run).orderBy("kind", "ord").toLocalIterator():
        out[r.kind].append(json.loads(r.json))
    suppliers = [r.supplier_name for r in run.suppliers.orderBy("supplier_ord").toLocalIterator()]
    comparison = {"suppliers": suppliers, "groups": out["group"], "missing": out["missing"], "notes": [n["note"] for n in out["note"]]}
    return json.dumps({"quotes": out["quote"], "findings": out["finding"], "comparison": comparison, "failed_files": out["failed_file"]}, ensure_ascii=False, indent=2)


def report(run: Run) -> str:
    """The report for people, with its lines in a fixed order."""
    s = P.summary(run.quotes, run.lines).first()
    unsupported = run.failures.filter(F.startswith("reason", F.lit(P.UNSUPPORTED_MARK))).count()
    suppliers = [r.supplier_name for r in run.suppliers.orderBy("supplier_ord").collect()]
    groups = run.groups.agg(F.count("*").alias("n"), F.count_if("review").alias("review")).first()
    out = ["报价处理报告", "=" * 40, f"处理文件数: {s.n_files + unsupported}", f"成功解析: {s.n_with_lines}", f"失败: {run.failures.count()}", f"报价行总数: {s.n_lines}"]
    out += ["", "比价分析:", f"  供应商: {len(suppliers)} 家（{'、'.join(suppliers)}）", f"  物料组: {groups.n} 组", f"  缺报: {run.missing.count()} 条", f"  待人工确认匹配: {groups.review} 组"]
    out += [f"    - {r.note}" for r in run.notes.orderBy("kind", "o").toLocalIterator()] + [""]
    stats = P.file_stats(run.quotes, run.lines).select("source_file", "n_lines").join(run.quotes, "source_file").orderBy("source_file")
    for q in stats.toLocalIterator():
        out += [f"[{q.source_file}] 供应商: {q.supplier_name}，{q.n_lines} 行，{len(q.warnings)} 条警告", *[f"    - {w}" for w in q.warnings]]
    lost = [f"    - {r.file}: {r.reason}" for r in run.failures.orderBy("file").toLocalIterator()]
    out += ["", "失败清单:", *lost] if lost else []
    found = [f"    [{r.rule}] {r.target}: {r.message}" for r in run.findings.orderBy("source_file", "rule_ord", "line_no", "part").toLocalIterator()]
    return "\n".join([*out, "", f"校验发现: {len(found)} 条", *found, "", "提示: 标黄（低置信/校验未过/待确认匹配）的单元格需要人工复核后再使用。"])
