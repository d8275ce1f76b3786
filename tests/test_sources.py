import numpy as np
import pytest

from tallystone.operators import extraction as X
from tallystone.sources import files, ocr, settings
from tallystone.streaming.latest import latest_of_files


def test_engines():
    assert ocr.choose("auto", lambda n: True) == "paddle"
    assert ocr.choose("auto", lambda n: "paddle" not in n) == "rapid"
    assert ocr.choose("rapid", lambda n: True) == "rapid"
    for preference in ("auto", "paddle", "rapid", "other"):
        with pytest.raises(ImportError):
            ocr.choose(preference, lambda n: n == "onnxruntime")
    text, warnings, low = files.ocr_text(b"x", "image", ocr.engine("paddle"))
    assert (text, low) == ("", []) and warnings[0].startswith("OCR 引擎不可用")
    assert files.ocr_text(b"", "image", lambda d, k: 1 / 0)[1] == ["OCR 处理失败: division by zero"]


def test_straightening():
    assert ocr.straightened(np.zeros((2, 2))).shape == (2, 2)
    page = np.full((300, 400, 3), 255.0)
    for y in range(40, 260, 20):
        page[y : y + 4, 50:350] = 0
    assert abs(ocr.slant(page.mean(axis=2))) < 0.11 and ocr.levelled(page) is page
    for degrees in (-6.0, 4.0):
        c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        turned = ocr.sampled(page, np.array([[c, s, 200 - c * 200 - s * 150], [-s, c, 150 + s * 200 - c * 150], [0, 0, 1]]), (300, 400))
        assert abs(ocr.slant(turned.mean(axis=2)) - degrees) < 0.3
        assert abs(ocr.slant(ocr.levelled(turned).mean(axis=2))) < 0.3
    corners = np.array([[60.0, 40], [340, 55], [350, 260], [50, 250]])
    y, x = np.mgrid[:300, :400]
    sides = zip(corners, np.roll(corners, -1, axis=0), strict=True)
    inside = np.all([(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in sides], axis=0)
    photo = np.where(inside[:, :, None], 230.0, 20.0) * np.ones(3)
    assert np.abs(ocr.sheet(photo.mean(axis=2)) - corners).max() < 4
    assert ocr.straightened(photo).mean() > 225 and ocr.sheet(page.mean(axis=2)) is None


def test_settings(tmp_path, monkeypatch):
    own = tmp_path / "s.yml"
    own.write_text("llm:\n  model: other\nextra: 1\n")
    got = settings.settings(own)
    assert got["llm"]["model"] == "other" and got["llm"]["max_retries"] == 3 and got["extra"] == 1
    assert settings.settings()["compare"]["amount_tolerance"] == 0.02
    with pytest.raises(FileNotFoundError):
        settings.settings(tmp_path / "none.yml")
    (tmp_path / ".env").write_text("# no\nA_KEY='x'\nB_KEY=y\nnot a line\n")
    monkeypatch.setenv("B_KEY", "kept")
    monkeypatch.delenv("A_KEY", raising=False)
    settings.load_env(tmp_path / ".env")
    import os

    assert os.environ.pop("A_KEY") == "x" and os.environ["B_KEY"] == "kept" and settings.env_file(tmp_path / "none") == {}


def test_layers():
    assert settings.layered({"a": {"b": 1, "c": {"d": 2}}, "e": [1]}, {"a": {"c": {"d": 3, "x": 4}}, "e": None}) == {"a": {"b": 1, "c": {"d": 3, "x": 4}}, "e": None}
    assert settings.layered({"a": {"b": 1}}, {"a": 5}) == {"a": 5} and settings.layered({"a": 5}, {"a": {"b": 1}}) == {"a": {"b": 1}} and settings.layered({"a": {"b": 1}}, None, {"a": {}}) == {"a": {}}


def test_pdf_pieces():
    class Page:
        def __init__(self, text, tables):
            self.extract_text, self.extract_tables = lambda: text, lambda: tables

    text = files.rendered(files.pdf_pieces([Page("报价", [[["a", None], [], [1.0, True]]]), Page(None, [[]]), Page("", None)]))
    assert text == "[第1页 文本]\n报价\n\n[第1页 表格]\n| a |  |\n| --- | --- |\n| 1 | 是 |"
    assert files.rendered([("Sheet: x", [["a"], [None, "b"], [], [""]]), ("Sheet: y", [[]])]) == "Sheet: x\n| a |  |\n| --- | --- |\n|  | b |"


def test_units(tmp_path):
    from tallystone.plans.rules import reverse_units

    (tmp_path / "u.yml").write_text("件: [个, PCS]\n台:\n")
    assert reverse_units(settings.units(tmp_path / "u.yml")) == {"件": "件", "个": "件", "pcs": "件", "台": "台"}


def test_answers():
    assert X.json_part('```json\n{"a": 1}\n```') == {"a": 1} and X.json_part('so: {"a": {"b": 2}} end') == {"a": {"b": 2}}
    for bad in ("", "none", "{not json}", None, '{"a": 1} and {"b": 2}'):
        with pytest.raises(ValueError):
            X.json_part(bad)
    waits, tries = [], []

    class Flaky:
        def call(self, messages, response_format):
            tries.append(1)
            if len(tries) < 3:
                raise TimeoutError
            return '{"ok": true}'

    assert X.ask(Flaky(), [], None, 3, 1.0, waits.append) == ({"ok": True}, None) and waits == [1.0, 2.0]
    tries.clear()
    answer, error = X.ask(Flaky(), [], None, 2, 0)
    assert answer is None and "2" in error


def test_replay():
    messages, form = X.request("s", "u", "n", {"type": "object"})
    assert form["json_schema"]["strict"] and X.request("s", "u", "n", {}, "json_object")[1] == {"type": "json_object"} and X.request("s", "u", "n", {}, "none")[1] is None
    player = X.Replay({X.request_key(messages, form): '{"a": 1}'})
    assert X.ask(player, messages, form) == ({"a": 1}, None)
    assert X.ask(player, messages, None, 1)[0] is None
    with pytest.raises(ValueError):
        X.Http("http://x", "m", "")


def test_schemas():
    lines = X.QUOTE_SCHEMA["properties"]["lines"]["items"]
    assert lines["required"][:3] == ["item_name", "spec", "quantity_raw"] and lines["properties"]["tax_included"]["type"] == ["boolean", "null"] and not lines["additionalProperties"]
    assert X.MATCH_SCHEMA["properties"]["results"]["items"]["properties"]["same"] == {"type": "boolean"}
    assert X.valid_line({"item_name": "a"}) and not X.valid_line({"item_name": 1}) and not X.valid_line({"confidence": "mid"}) and not X.valid_line({"tax_included": "yes"})


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k int, t int, v string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    got = latest_of_files(spark, str(tmp_path / "in"), rows.schema, ("k",), ("t",)).collect()
    assert sorted((r.k, r.t, r.v) for r in got) == [(1, 2, "b"), (2, 5, "c")]


def test_stream_of_findings_reads_each_file_once(spark, tmp_path):
    from tallystone.plans import rules
    from tallystone.streaming.latest import append_available, lines_of_files

    names = ("item_name", "unit_price_raw", "quantity_raw", "amount_raw", "remark", "currency", "source_snippet", "lead_time_raw", "unit")
    schema = "source_file string, line_no int, quantity double, unit_price double, lead_time_days int, tax_included boolean, flags array<string>, " + ", ".join(f"{n} string" for n in names)

    def add(k):
        row = {"source_file": f"f{k}", "line_no": k, "item_name": "", "unit_price_raw": "面议", "lead_time_raw": "尽快", "flags": []}
        rows = spark.createDataFrame([row], schema)
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        out = str(tmp_path / "out")
        append_available(rules.findings(rules.apply_rules(lines_of_files(spark, str(tmp_path / "in"), rows.schema))), out, str(tmp_path / "state"))
        return sorted((r.source_file, r.rule) for r in spark.read.parquet(out).collect())

    assert add(1) == [("f1", "V1"), ("f1", "V2"), ("f1", "V5")]
    assert add(2) == [(f, v) for f in ("f1", "f2") for v in ("V1", "V2", "V5")]
