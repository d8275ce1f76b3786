from pyspark.sql import functions as F

import pytest

from tallystone.functions import text as T


def apply(spark, make, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_parse_number(spark):
    cases = {"4件": 4, "¥1,200.00": 1200, "¥1,200.00（含税13%）": 1200, "0.048元一个": 0.048, "8块2一个": 8.2, "25块一个": 25, "68块钱一个": 68, "1,250": 1250, "1，250": 1250, "-5": -5, "１２个": 12, "7-10": 7, "8块2毛5": 8.2, "25块 10个": 25.1, "": None, "面议": None, "价格详谈": None, None: None}
    assert apply(spark, T.parse_number, cases) == list(cases.values())


def test_lead_times(spark):
    cases = {
        "现货": 0, "现货供应": 0, "当天发货": 0, "7天": 7, "3个工作日": 3, "10天以内": 10, "一周": 7, "两周": 14, "3周": 21, "一个星期": 7, "半个月": 15, "一个月": 30, "2个月": 60, "7-10天": 10, "7~10天": 10,
        "订货要20天": 20, "约15天左右": 15, "货期12天": 12, "二十天": 20, "十二天": 12, "１０天": 10, "": None, "尽快": None, "电议": None, "一二天": None, None: None,
    }
    assert apply(spark, T.parse_lead_time, cases) == list(cases.values())


def test_confusion_and_currency(spark):
    assert apply(spark, T.ocr_confusion, ["5O个", "l65元", "8.5O元", "1I件", "50个"]) == [True, True, True, True, False]
    assert apply(spark, T.detect_currency, ["$100", "HK$50", "¥100", "usd 3", "3 欧元", ""]) == ["USD", "HKD", None, "USD", "EUR", None]
    assert apply(spark, T.detect_tax, ["含税13%", "未税", "不含税", ""]) == [True, False, False, None]


def test_normalize(spark):
    got = apply(spark, T.normalize_text, ["外六角螺母 M6×16", "外六角螺母 m6*16", "Ｍ６×１６", "QD40*80", None])
    assert got == ["外六角螺母m6x16", "外六角螺母m6x16", "m6x16", "qd40x80", ""]
    assert apply(spark, T.normalize_nfkc, ["Ｍ６×１６", "① ㎜"]) == ["m6x16", "1mm"]


def test_likely_same(spark):
    pairs = [("角接触轴承 72O5", "角接触轴承 7205", True), ("外六角螺母 M6×16", "光电开关 M18 PNP", False), ("ab", "xaby", True), ("a", "ab", False), ("轴承 7205", "x-7205-y", True)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", T.likely_same(T.normalize_text(F.col("a")), T.normalize_text(F.col("b"))).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [p[2] for p in pairs]


@pytest.mark.parametrize("make, form", [(T.general, "{:g}"), (T.signed, "{:+g}")])
def test_general(spark, make, form):
    values = [0.0, 425.0, -75.0, 0.05, 1234567.0, 1e-5, 0.0001234567, 100000.0, 999999.5, 12.3456789, -0.5, 1e22, 250.0]
    assert apply(spark, make, values, "double") == [form.format(v) for v in values]


def test_small_texts(spark):
    assert apply(spark, T.strip, ["　a b ", "\x1c", None]) == ["a b", "", None]
    assert apply(spark, T.is_blank, ["　", "", None, "x"]) == [True, True, True, False]
    assert apply(spark, T.provenance, ["| a |\n b", None]) == ["ab", ""]
    assert apply(spark, T.quoted, ["a", "it's", 'a\'"', "x\ny"]) == [repr("a"), repr("it's"), repr('a\'"'), repr("x\ny")]
    assert apply(spark, T.safe_name, ['a/b:c*"d|']) == ["a_b_c__d_"]
    assert apply(spark, T.chinese_int, ["七", "十", "十二", "二十", "两", "15", "百", "二三", ""]) == [7, 10, 12, 20, 2, 15, None, None, None]
    assert apply(spark, T.is_supplement, ["x-补充.txt", "更正", "更新1", "x"]) == [1, 1, 1, 0]


def test_functions_in_sql(spark):
    from tallystone.functions import sql

    assert "chunk_lines" in sql.register(spark)
    rows = spark.createDataFrame([("约 3-5 天", "12块5"), ("半个月", "¥1,234.50"), ("两周", None), ("面议", "x")], "t string, p string")
    rows.createOrReplaceTempView("terms")
    got = spark.sql("SELECT parse_lead_time(t), parse_number(p), detect_tax(concat(t, '不含税')), item_key(t, p) FROM terms").collect()
    want = rows.select(T.parse_lead_time(F.col("t")), T.parse_number(F.col("p")), T.detect_tax(F.concat("t", F.lit("不含税"))), T.item_key(F.col("t"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0][0] == 5 and got[1][1] == 1234.5
    got = spark.sql("SELECT d.i, c.* FROM VALUES (1, 'aa\nbbbbbb\nc\n'), (2, NULL), (3, '') AS d(i, x), LATERAL chunk_lines(d.x, 5) c ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(1, 0, 3, "aa\n"), (1, 1, 3, "bbbbbb\n"), (1, 2, 3, "c\n"), (3, 0, 1, "")]


def test_slow_patterns_are_guarded_and_agree(spark):
    ends = ["", " ", "a", " a", "a　", " 元", "元", "¥5元", "\x1c1\x1f", " 天\u0085", "～5 ", "\x7f", None]
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(ends)], "i int, t string")
    old = F.regexp_replace("t", rf"(?U)^{T.SPACE}+|{T.SPACE}+$", "")
    assert [r for r in rows.select(old.alias("a"), T.strip(F.col("t")).alias("b")).collect() if r.a != r.b] == []
    for column in (T.strip(F.col("t")), T.detect_currency(F.col("t")), T.parse_lead_time(F.col("t"))):
        assert "CASE WHEN" in rows.select(column.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "RLIKE(t#" in (plan := rows.select(T.detect_currency(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()) and T.CURRENCY_STARTS in plan
    terms = spark.createDataFrame([("hKd 5", "3 - 5 个工作日"), ("us$", "两星期"), ("欧元", "半个月"), ("uſd", "三个月"), ("元", "2到4日"), (None, None)], "c string, l string")
    got = [(r.c, r.l) for r in terms.select(T.detect_currency(F.col("c")).alias("c"), T.parse_lead_time(F.col("l")).alias("l")).collect()]
    assert got == [("HKD", 5), ("USD", 14), ("EUR", 15), ("USD", 90), (None, 4), (None, None)]
