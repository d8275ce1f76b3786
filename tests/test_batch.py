"""A whole run over six made-up files with planted defects, answered by a transport of the test."""

import io
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallystone.plans import batch, reports
from tallystone.sinks import report
from tallystone.sinks.workbook import Cell, Sheet, write
from tallystone.sources import files as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't import tests

ITEMS = [("高型烧杯", "250mL 带刻度", "个", 120), ("丁腈手套", "L码 无粉", "件", 15), ("磁力搅拌子", "C型 30mm", "只", 40), ("活性炭滤棉", "适配QH-30", "个", 6), ("恒温水浴锅", "双列4孔", "台", 3), ("封口膜", "10cm×38m", "卷", 12), ("移液器支架", "6位 转盘", "个", 5), ("防护眼镜", "防雾 PC镜片", "个", 25)]
PRICES = {"青禾实验器材有限公司": [7.4, 32, 3.1, 58, 940, 112, 85, 19.5], "鸿安劳保": [7.9, 30.5, 2.8, 61, 905, 118, 79, 18], "北原办公用品公司": [7.2, 34, 3.3, 55, 980, 109, None, 21], "启明包装贸易部": [8.1, 31, 2.9, 63, 890, 121, 82, 17.8]}
LEADS = ["现货", "三天", "5天", "两周", "25天", "现货", "9天", "4天"]
SUPPLEMENT = [("活性炭滤棉", "适配QH-30加厚", 53.5), ("防护眼镜", "防雾 PC镜片", 18.8)]


def line(name, spec, unit, qty, price, lead, amount=""):
    return {"item_name": name, "spec": spec, "quantity_raw": f"{qty}{unit}", "unit": unit, "unit_price_raw": f"{price}", "amount_raw": f"{amount}", "currency": "CNY", "tax_included": None, "lead_time_raw": lead, "payment_terms": "", "remark": "含税13%", "confidence": "high", "source_snippet": f"{name} {spec} {price}"}


def payload(supplier):
    out = [line(n, s, u, q, p, LEADS[i]) for i, ((n, s, u, q), p) in enumerate(zip(ITEMS, PRICES[supplier], strict=True)) if p is not None]
    if supplier.startswith("青禾"):
        out[1]["amount_raw"] = "500"
    if supplier.startswith("鸿安"):  # another wording, which ties the supplement's to the others'
        out[3] = line("活性炭滤棉", "QH-30通用", "个", 6, 61, LEADS[3])
    return {"supplier_name": supplier, "lines": out}


def text_of(data):
    return data["supplier_name"] + "\n" + "\n".join(f"{x['item_name']} | {x['spec']} {x['unit_price_raw']}" for x in data["lines"])


class Model:
    """Answers by the file name in the prompt; a match is sure if both texts start alike."""

    def __init__(self, answers, broken=()):
        self.answers, self.broken = answers, broken

    def call(self, messages, response_format):
        user = messages[1]["content"]
        if "{\"pairs\"" in user:
            pairs = json.loads(user[user.index('{"pairs"') :])["pairs"]
            return json.dumps({"results": [{"id": p["id"], "same": p["a"][:4] == p["b"][:4], "confidence": "high", "reason": "同名"} for p in pairs]})
        name = user.split("\n")[0].removeprefix("文件名: ")
        if name in self.broken:
            raise TimeoutError("no answer")
        return "```json\n" + json.dumps(self.answers[name], ensure_ascii=False) + "\n```"


def xlsx(rows) -> bytes:
    out = io.BytesIO()
    write(out, [Sheet("报价", rows)])
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("quotes")
    answers = {}
    for file, supplier in (("青禾器材.xlsx", "青禾实验器材有限公司"), ("鸿安劳保.txt", "鸿安劳保"), ("北原办公.csv", "北原办公用品公司"), ("_启明.md", "启明包装贸易部")):
        answers[file] = payload(supplier)
        text = text_of(answers[file])
        (at / file).write_bytes(xlsx([[c for c in r.split(" | ")] for r in text.split("\n")]) if file.endswith("xlsx") else text.encode("gb18030" if file.endswith("txt") else "utf-8"))
    more = {"supplier_name": "青禾实验器材有限公司", "lines": [line(n, s, "个", 6, p, "8天") for n, s, p in SUPPLEMENT]}
    more["lines"][1]["source_snippet"] = "不在原文中"
    answers["青禾器材-补充.txt"] = more
    (at / "青禾器材-补充.txt").write_text(text_of(more))
    answers["坏.txt"] = {}
    (at / "坏.txt").write_text("无法解析")
    (at / "空.txt").write_text("")
    (at / "图.png").write_bytes(b"x")
    (at / "备注.doc").write_bytes(b"x")
    (at / ".隐藏.txt").write_text("x")
    return str(at), answers


@pytest.fixture(scope="module")
def run(spark, folder):
    at, answers = folder
    return batch.run(spark, at, lambda: Model(answers, ("坏.txt",)), settings={"llm": {"retry_delay": 0}})


def test_files(run):
    kinds = {r.source_file: r.kind for r in run.files.collect()}
    assert kinds == {"青禾器材.xlsx": "excel", "鸿安劳保.txt": "text", "北原办公.csv": "text", "_启明.md": "text", "青禾器材-补充.txt": "text", "坏.txt": "text", "空.txt": "text", "图.png": "image", "备注.doc": "unsupported"}
    raw = {r.source_file: r for r in run.raw.collect()}
    assert "| 高型烧杯 | 250mL 带刻度 7.4 |" in raw["青禾器材.xlsx"].raw_text and "Sheet: 报价" in raw["青禾器材.xlsx"].raw_text
    assert raw["空.txt"].extraction_warnings == ["空文件"] and raw["图.png"].extraction_warnings[0].startswith("OCR 引擎不可用")
    assert "鸿安劳保" in raw["鸿安劳保.txt"].raw_text


def test_quotes(run):
    quotes = {r.source_file: r for r in run.quotes.collect()}
    assert quotes["坏.txt"].supplier_name == "未知供应商" and quotes["坏.txt"].warnings[0].startswith("LLM_FAILED")
    assert any(w.startswith("H1") for w in quotes["青禾器材-补充.txt"].warnings)
    assert {(r.file, r.reason[:5]) for r in run.failures.collect()} == {("坏.txt", "LLM 解"), ("备注.doc", "不支持的格")}
    assert run.lines.count() == 8 + 8 + 7 + 8 + 2


def test_rules(run):
    found = run.findings.collect()
    assert [(r.target, r.rule) for r in found if r.rule == "V3"] == [("青禾器材.xlsx#行2", "V3")]
    assert next(r.message for r in found if r.rule == "V3") == "金额不符: 15×32=480 ≠ 报价金额 500（差额 -20）"
    assert {r.unit for r in run.lines.collect()} == {"件", "台", "卷"}


def test_comparison(run):
    groups = {r.item_name: r for r in run.groups.collect()}
    assert run.groups.count() == len(groups) == 8 and all(r.n_entries >= 3 for r in groups.values())
    missing = [(r.item, r.supplier_name) for r in run.missing.collect()]
    assert missing == [("移液器支架 6位 转盘", "北原办公用品公司")]
    own = {(r.group_key, r.supplier_name): r for r in run.entries.collect()}
    east = "青禾实验器材有限公司"
    assert own[groups["防护眼镜"].group_key, east].unit_price == 18.8  # by key
    assert own[groups["活性炭滤棉"].group_key, east].unit_price == 53.5  # by the match, then within the group
    assert groups["高型烧杯"].min_price == 7.2


def test_outputs(run, tmp_path):
    out = tmp_path / "a.xlsx"
    assert report.write_workbook(run, str(out)) == ["比价总表", "明细数据", "统计与异常", "解析失败原文"]
    sheets = dict(S.xlsx_sheets(out.read_bytes()))
    assert sheets["比价总表"][0][0] == "物料名称" and len(sheets["比价总表"]) == 10 and len(sheets["明细数据"]) == 34
    data = json.loads(report.result_json(run))
    assert len(data["comparison"]["groups"]) == 8 and len(data["comparison"]["missing"]) == 1 and len(data["failed_files"]) == 2
    text = report.report(run)
    assert "处理文件数: 9" in text and "报价行总数: 33" in text and "[V3] 青禾器材.xlsx#行2" in text


def test_cached_answers(spark, folder, tmp_path):
    at, answers = folder
    prompts = spark.createDataFrame([("a.txt", 0, "文件名: 鸿安劳保.txt\nx"), ("b.txt", 0, "文件名: 坏.txt\nx")], "source_file string, chunk_no int, prompt string")
    ask = lambda model: batch.answered(prompts, lambda: model, "s", "n", {}, cache=str(tmp_path / "c"), delay=0).orderBy("source_file").collect()
    first = ask(Model(answers, ("坏.txt",)))
    assert [r.error is None for r in first] == [True, False]
    again = ask(Model({"坏.txt": {"lines": []}}))  # the first isn't asked again
    assert [r.error for r in again] == [None, None] and again[0].answer == first[0].answer


def test_command_line_over_recordings(spark, folder, tmp_path, capsys):
    """Answers are recorded under their requests' keys; then a whole run needs no model, and a second one no readers."""
    from tallystone.__main__ import main
    from tallystone.operators import extraction as X

    at, answers = folder
    kept = tmp_path / "replay"
    kept.mkdir()

    class Recorder(Model):
        def call(self, messages, response_format):
            text = super().call(messages, response_format)
            (kept / f"{X.request_key(messages, response_format)}.json").write_text(json.dumps({"response": text}))
            return text

    want = batch.run(spark, at, lambda: Recorder(answers, ("坏.txt",)), settings={"llm": {"retry_delay": 0}})
    want = json.loads(report.result_json(want))
    for k in range(2):
        assert main([at, str(tmp_path / f"out{k}"), "--replay", str(kept), "--cache", str(tmp_path / "cache")]) == 0
        got = json.loads((tmp_path / f"out{k}" / "result.json").read_text())
        assert got["comparison"] == want["comparison"] and (tmp_path / f"out{k}" / "comparison.xlsx").exists()
        assert "报价行总数: 33" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "cache" / "texts")).count() == 6


def test_answers_of_settings(monkeypatch):
    from tallystone.operators import extraction as X

    llm = {"base_url": "http://x/", "model": "m", "api_key_env": "A_KEY_OF_TESTS", "temperature": 0.5, "timeout": 3}
    monkeypatch.delenv("A_KEY_OF_TESTS", raising=False)
    with pytest.raises(ValueError):
        X.http_of(llm)
    monkeypatch.setenv("A_KEY_OF_TESTS", "k")
    made = X.http_of(llm)()
    assert (made.url, made.model, made.key, made.temperature, made.timeout) == ("http://x/chat/completions", "m", "k", 0.5, 3)


def test_empty_folder(spark, tmp_path):
    out = batch.run(spark, str(tmp_path), lambda: Model({}))
    assert out.lines.count() == out.groups.count() == out.failures.count() == 0
    assert reports.summary(out.quotes, out.lines).first().n_files == 0


def test_cells():
    assert [S.cell_text(v) for v in (None, True, 3.0, 2.5, "a|b\nc ", 7)] == ["", "是", "3", "2.5", "a｜b c", "7"]
    assert S.decoded("价格".encode("gb18030")) == ("价格", []) and S.decoded(b"") == ("", ["空文件"])
    assert S.markdown([["a", "b"], ["c"]]) == "| a | b |\n| --- | --- |\n| c |  |"
    assert S.ocr_text(b"", "image", lambda d, k: [("a", 0.99), ("b", 0.5), ("c", 0.85)])[2] == ["b"]
    assert [r for _, r in S.xlsx_sheets(xlsx([[Cell("x", "FFC7CE"), 1.5, True], [], ["y"]]))] == [[["x", 1.5, True], [], ["y"]]]


def test_kinds(spark):
    names = ["a.XLSX", "b.tar.txt", "c.JPEG", "d.pdf", ".txt", "e", "f.docx"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", S.kind_of(F.col("n")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == ["excel", "text", "image", "pdf", "unsupported", "unsupported", "unsupported"]
    pdfs = spark.createDataFrame([("a.pdf", "a.pdf", bytearray(b"x" * 101)), ("b.pdf", "b.pdf", bytearray(b"x" * 100))], "file string, source_file string, content binary")
    assert [r.kind for r in S.classify(pdfs, len).orderBy("file").collect()] == ["pdf_digital", "pdf_scanned"]
