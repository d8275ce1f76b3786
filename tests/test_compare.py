import random

import pytest
from pyspark.sql import functions as F

from tallystone.functions import text as T
from tallystone.operators import compare as C
from tallystone.plans import rules as R

PLAIN = "source_file string, line_no int, supplier_name string, item_name string, spec string, unit_price double, lead_time_days int, quantity double, confidence string, flags array<string>"


def lines(spark, rows):
    return spark.createDataFrame([(f, n, s, i, sp, p, d, 1.0, c, fl) for f, n, s, i, sp, p, d, c, fl in rows], PLAIN)


def merged(spark, df):
    m = C.merge_last(C.keyed(df))
    return m.join(C.supplier_order(m), "supplier_name")


def normal(text):
    return "".join(text.lower().replace("×", "x").replace("*", "x").split())


def likely(a, b):
    import re

    a, b = normal(a), normal(b)
    if (len(a) >= 2 and a in b) or (len(b) >= 2 and b in a):
        return True
    digits = lambda s: {t for t in re.findall("[a-z0-9]+", s) if re.search("[0-9]", t)}
    cjk = lambda s: "".join(re.findall("[一-鿿]+", s))
    grams = lambda s: {cjk(s)[i : i + 3] for i in range(len(cjk(s)) - 2)}
    return bool(digits(a) & digits(b) or grams(a) & grams(b))


def test_candidates_match_brute_force(spark):
    rnd = random.Random(4)
    words = ["轴承", "角接触轴承", "7205", "m6", "螺母", "M6×16", "a", "ab", "闸阀", "dn40", " "]
    rows = [(f"f{rnd.randint(0, 3)}", i, f"s{rnd.randint(0, 4)}", "".join(rnd.choices(words, k=rnd.randint(1, 2))), rnd.choice(words), 1.0, 1, "high", []) for i in range(70)]
    m = merged(spark, lines(spark, rows))
    groups = C.first_groups(m)
    got = {(r.a_key, r.b_key) for r in C.candidate_pairs(m, groups).collect()}
    g = sorted(groups.collect(), key=lambda r: r.group_place)
    has = {}
    for r in m.collect():
        has.setdefault(r.item_key, set()).add(r.supplier_name)
    want, seen = set(), set()
    for o in g:
        for x in g if o.n_entries == 1 else ():
            if o.item_key != x.item_key and o.first_supplier not in has[x.item_key] and likely(f"{o.item_name} {o.spec}".strip(), f"{x.item_name} {x.spec}".strip()) and frozenset((o.item_key, x.item_key)) not in seen:
                seen.add(frozenset((o.item_key, x.item_key)))
                want.add((o.item_key, x.item_key))
    assert got == want and got


def test_candidates_in_blocks_and_without_broadcasts(spark, monkeypatch):
    words = ["largering", "hotbolt", "m6", "轴承7205", "角接触轴承7205大", "x"]
    rows = [(f"f{i % 3}", i, f"s{i % 4}", words[i % 6] * (1 + i % 3), f"{i % 5}x{i % 7}", 1.0, 1, "high", []) for i in range(60)]
    m = merged(spark, lines(spark, rows))
    groups = C.first_groups(m)
    whole = sorted(C.candidate_pairs(m, groups).collect())
    monkeypatch.setattr(C, "BLOCK_GROUPS", 2)
    pairs = C.candidate_pairs(m, groups)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(pairs.collect()) == whole and whole


def fold(spark, keys, results):
    groups = spark.createDataFrame([(k, k, "", i) for i, k in enumerate(keys)], "item_key string, item_name string, spec string, group_place int")
    pairs = spark.createDataFrame([(str(i), a, b) for i, (a, b, _) in enumerate(results)], "pair_id string, a_key string, b_key string")
    answers = spark.createDataFrame([(str(i), True, c, "r", i) for i, (_, _, c) in enumerate(results)] + [("99", True, "high", "", 99)], "id string, same boolean, confidence string, reason string, ord int")
    return {r.item_key: r for r in C.match_fold(groups, pairs, answers).collect()}


def test_fold_is_no_closure(spark):
    out = fold(spark, "abc", [("a", "b", "high"), ("a", "c", "high")])
    assert {k: r.final_key for k, r in out.items()} == {"a": "b", "b": "b", "c": "c"}
    chain = fold(spark, "abc", [("a", "b", "high"), ("b", "c", "high")])
    assert {r.final_key for r in chain.values()} == {"c"}
    low = fold(spark, "abcd", [("a", "d", "low")])
    assert [k for k in sorted("abcd", key=lambda k: low[k].group_ord)] == ["a", "d", "b", "c"] and low["a"].review and not low["b"].review


def plain_fold(keys, results):
    """The fold by one list, in the order of the results: (final key, place, review, notes) of each key, and what is said."""
    order, into, review, notes, said = list(keys), {k: k for k in keys}, set(), {k: [] for k in keys}, []
    for a, b, confidence in results:
        if into[a] != a or into[b] != b:
            continue
        if confidence == "high":
            into[a] = b
            order.remove(a)
            notes[b].append(f"LLM 合并: '{a}' 并入本组（r）")
            said.append((a, f"物料合并: '{a}' ≈ '{b}'"))
        else:
            review |= {a, b}
            for x, y in ((a, b), (b, a)):
                notes[x].append(f"疑似与 '{y}' 同物料（低置信，未合并，请人工确认）")
            said.append((a, f"待确认匹配: '{a}' ? '{b}'"))
            order.remove(b)
            order.insert(order.index(a) + 1, b)
    end = lambda k: k if into[k] == k else end(into[k])
    return {k: (end(k), order.index(end(k)), end(k) in review, notes[end(k)], [(i, n) for i, (a, n) in enumerate(said) if a == k]) for k in keys}


@pytest.mark.parametrize(("rows", "high"), [(100_000, 0.3), (0, 0.1), (0, 0.9), (2, 0.6)])
def test_fold_is_that_of_one_list(spark, monkeypatch, rows, high):
    # results in any order, more than one task is given
    monkeypatch.setattr(C, "FOLD_ROWS", rows, raising=False)
    monkeypatch.setattr(C, "CONTROL_ROWS", 10, raising=False)
    rnd = random.Random(rows + high)
    keys = [f"k{i:02}" for i in range(30)]
    results = [(*rnd.sample(keys, 2), "high" if rnd.random() < high else "low") for _ in range(60)]
    # a chain of placings and one of moves
    results += [(x, y, "low") for x, y in zip(keys[20:], keys[21:])] + [(x, y, "high") for x, y in zip(keys[:8], keys[1:])][::-1]
    out = fold(spark, keys, results)
    got = {k: (r.final_key, r.group_ord, r.review, r.notes, [tuple(n) for n in r.global_notes]) for k, r in out.items()}
    assert got == plain_fold(keys, results) and all(r.n_notes == len(r.notes) for r in out.values())


def test_numbers_of_pairs_are_told_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "CONTROL_ROWS", 10, raising=False)
    rows = [(f"a{i % 7}", f"b{i}", i % 7, -i) for i in range(50)]
    pairs = C.numbered(spark.createDataFrame(rows, "a_key string, b_key string, a_place int, b_place int").repartition(5))
    assert [(r.a_key, r.b_key) for r in sorted(pairs.collect(), key=lambda r: int(r.pair_id))] == [r[:2] for r in sorted(rows, key=lambda r: r[2:])]
    assert sorted(int(r.pair_id) for r in pairs.collect()) == list(range(50))


def test_degraded(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a_key string, b_key string")
    assert {(r.item_key, r.n_notes) for r in C.match_degraded(pairs).collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_colours(spark):
    rows = [("f1", 1, "A", "X", "", 100.0, 5, "high", []), ("f2", 1, "B", "X", "", 140.0, 5, "high", []), ("f3", 1, "C", "X", "", 100.0, 20, "low", []), ("f1", 2, "A", "Y", "", 1.0, 5, "high", []), ("f2", 2, "B", "Y", "", 1.1, 30, "high", []), ("f1", 3, "A", "Z", "", 0.0, None, "high", []), ("f2", 3, "B", "Z", "", 0.0, 3, "high", ["V2"]), ("f3", 3, "C", "Z", "", None, 3, "high", [])]
    cells = {(r.item_key[0], r.supplier_name): r for r in C.matrix(merged(spark, lines(spark, rows)), lead_factor=1.5).collect()}
    colour = lambda k: cells[k].price_color
    assert colour(("x", "A")) == C.GREEN and colour(("x", "B")) == C.RED and colour(("x", "C")) == C.YELLOW and colour(("y", "C")) == C.GRAY
    assert cells["y", "B"].lead_color == C.ORANGE and cells["z", "A"].deviation is None and colour(("z", "B")) == C.YELLOW and colour(("z", "C")) is None


def test_order_and_partitions_do_not_matter(spark):
    rnd = random.Random(1)
    rows = [(f"f{rnd.randint(0, 9)}{rnd.choice(['', '-补充'])}", i, f"s{rnd.randint(0, 3)}", f"i{rnd.randint(0, 9)}", "", float(rnd.randint(1, 9)), rnd.randint(0, 9), "high", []) for i in range(200)]
    shape = lambda df: sorted(map(str, C.matrix(merged(spark, df)).collect()))
    assert shape(lines(spark, rows).repartition(1)) == shape(lines(spark, rnd.sample(rows, len(rows))).repartition(7))


def test_rules(spark):
    names = "item_name quantity_raw unit unit_price_raw amount_raw remark lead_time_raw currency".split()
    data = [("", "5O个", "pcs", " ", "", "", "尽快", "CNY"), ("a", "5000", "托", "0.05", "250", "", "一周", "CNY"), ("a", "3", "Set", "100", "305", "含税", "", "CNY"), ("a", "50", "台", "8.5", "500", "", "", "CNY"), ("a", "1", "", "HK$5", "总价面议", "不含税", "", "CNY"), ("a", "2", "", "0", "0", "", "", "CNY")]
    rows = spark.createDataFrame([("f", i, *d) for i, d in enumerate(data, 1)], "source_file string, line_no int, " + ", ".join(f"{n} string" for n in names))
    rows = rows.withColumns({"quantity": F.lit(None).cast("double"), "unit_price": F.lit(None).cast("double"), "tax_included": F.lit(None).cast("boolean"), "lead_time_days": F.lit(None).cast("int"), "source_snippet": F.lit(""), "flags": F.array().cast("array<string>")})
    checked = {r.line_no: r for r in R.apply_rules(rows).collect()}
    assert checked[1].flags == ["V1", "V2", "V5"] and checked[1].quantity == 5 and checked[1].unit == "件"
    assert checked[1].line_findings[0].message == "必填字段缺失: 物料名称、单价"
    assert checked[2].flags == [] and checked[2].lead_time_days == 7 and checked[2].unit == "托"
    assert checked[3].flags == [] and checked[3].tax_included is True and checked[3].unit == "套"
    assert checked[4].flags == ["V3"] and "差额 -75" in checked[4].line_findings[0].message
    assert checked[5].flags == ["V3"] and checked[5].currency == "HKD" and checked[5].tax_included is False and checked[5].line_findings[-1].rule == "V4"
    assert checked[6].flags == []


def test_supplier_names(spark):
    raw = spark.createDataFrame([("a", "，云川仪器有限公司，远桥商贸有限公司"), ("b", "，云川仪器有限公司，云川仪器有限公司"), ("c", ""), ("d", None)], "source_file string, raw_text string")
    assert [(r.source_file, r.names) for r in R.supplier_names(raw).collect()] == [("a", ["云川仪器有限公司", "远桥商贸有限公司"])]


def test_snippets(spark):
    rows = spark.createDataFrame([("f", 1, "a | b"), ("f", 2, "zz"), ("f", 3, ""), ("f", 4, "| |"), ("f", 5, "low one")], "source_file string, line_no int, source_snippet string").withColumns({"confidence": F.lit("high"), "flags": F.array().cast("array<string>")})
    raw = spark.createDataFrame([("f", "x a b low one", ["low one here"])], "source_file string, raw_text string, low_ocr_lines array<string>")
    got = {r.line_no: (r.flags, r.confidence) for r in R.check_snippets(rows, raw).collect()}
    assert got == {1: ([], "high"), 2: (["H1"], "low"), 3: (["H1"], "low"), 4: ([], "high"), 5: (["OCR"], "low")}


def test_keys(spark):
    assert T.item_key is not None
    rows = lines(spark, [("a", 1, "S", "Ｍ８", "×2", 1.0, 1, "high", [])])
    assert C.keyed(rows).first().item_key == "m8|x2"
