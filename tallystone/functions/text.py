"""Text functions of the quotation rules, as columns.

Patterns see digits of any script as ASCII digits (ascii_digits) and white space as Unicode has it. Nothing
raises: what can't be parsed is null.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the information separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
# Fixed values of the rules.
KUAI = rf"(?U)([0-9]+){SPACE}*块{SPACE}*([0-9]{{1,2}})(?![0-9])"
NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
OCR_CONFUSION = r"[0-9][OIl]|[OIl][0-9]"
CURRENCIES = (("HKD", r"HK\$|HKD|港币|港元"), ("USD", r"\$|USD|美元|美金"), ("EUR", r"€|EUR|欧元"))
#: What any of these begins with: a text without it needs no slower pattern.
CURRENCY_STARTS = "[$€HhUuEe港美欧]"
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
IN_STOCK = "现货|当天|即日|即刻"
LEAD_NOISE = "约|左右|大概|大约|订货|货期|交期|内|需|要"
LEAD_NUMBER = "([0-9]+|[一二两三四五六七八九十]+)"
COMPANY = r"[\x{4e00}-\x{9fff}]{2,15}?(?:有限公司|公司|工厂|商行|贸易部|销售部)"
SUPPLEMENT = "补充|更正|更新"
CJK = r"[\x{4e00}-\x{9fff}]+"

_DIGITS = [(chr(c), str(unicodedata.digit(chr(c)))) for c in (*range(0xFF10, 0xFF1A), *range(0x0660, 0x066A), *range(0x06F0, 0x06FA), *range(0x0966, 0x0970))]
#: Full-width forms of ASCII and the ideographic space, which NFKC folds.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def ascii_digits(c: Column) -> Column:
    return F.translate(c, "".join(a for a, _ in _DIGITS), "".join(b for _, b in _DIGITS))


def strip(c: Column) -> Column:
    """Without white space around it. Texts that begin and end with common characters that are none don't meet the pattern, which is slow."""
    ends = [F.substring(c, 1, 1), F.substring(c, -1, 1)]
    plain = [e.between("!", "~") | e.between("一", "鿿") | e.between("¡", "ÿ") for e in ends]
    return F.when((c == "") | (plain[0] & plain[1]), c).otherwise(F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", ""))


def is_blank(c: Column) -> Column:
    """Whether nothing but white space is there; null is blank."""
    return F.coalesce(strip(c) == "", F.lit(True))


def parse_number(c: Column) -> Column:
    """The first number of a text, as double. "8块2" is 8.2; commas, wide ones too, group digits."""
    t = ascii_digits(c)
    spoken = F.concat(F.regexp_extract(t, KUAI, 1), F.lit("."), F.regexp_extract(t, KUAI, 2))
    plain = F.translate(F.regexp_extract(F.translate(t, "，", ","), NUMBER, 0), ",", "")
    return F.when(F.contains(c, F.lit("块")) & t.rlike(KUAI), spoken.try_cast("double")).otherwise(F.nullif(plain, F.lit("")).try_cast("double"))


def ocr_confusion(c: Column) -> Column:
    """Whether a digit stands next to a letter that is easily taken for one."""
    return c.rlike(OCR_CONFUSION)


def detect_currency(c: Column) -> Column:
    """The first of HKD, USD and EUR that the text names; null if none."""
    out = F.when(c.rlike(f"(?iu){CURRENCIES[0][1]}"), CURRENCIES[0][0])
    for code, pattern in CURRENCIES[1:]:
        out = out.when(c.rlike(f"(?iu){pattern}"), code)
    return F.when(c.rlike(CURRENCY_STARTS), out)


def detect_tax(c: Column) -> Column:
    """False for untaxed, true for taxed, null if the text says neither."""
    return F.when(c.rlike("不含税|未税"), False).when(F.contains(c, F.lit("含税")), True)


def chinese_int(c: Column) -> Column:
    """A whole number up to 99 in ASCII or Chinese digits; null for anything else."""
    digit = F.create_map(*[F.lit(x) for kv in CN_DIGITS.items() for x in kv])
    at = F.instr(c, "十")
    left = F.substring_index(c, "十", 1)
    right = F.substring(c, at + F.lit(1), F.length(c))
    tens = F.when(left == "", 1).otherwise(F.try_element_at(digit, left))
    ones = F.when(right == "", 0).otherwise(F.try_element_at(digit, right))
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int")).when(at > 0, tens * 10 + ones).otherwise(F.try_element_at(digit, c))


def lead_term(c: Column) -> Column:
    """A delivery term without white space around it and without words that say nothing, its digits in ASCII."""
    return F.regexp_replace(ascii_digits(strip(c)), LEAD_NOISE, "")


def lead_numbers(t: Column) -> dict[str, Column]:
    """What each form of a lead_term finds in it, empty for a form that doesn't fit: so that every pattern is matched once."""
    s = rf"{SPACE}*"
    days = rf"{s}(?:个)?(?:工作日|天|日)"
    span = rf"(?U){LEAD_NUMBER}{s}[-~到至]{s}{LEAD_NUMBER}{days}"
    of = lambda sign, pattern, n: F.when(sign, F.regexp_extract(t, pattern, n)).otherwise("")
    has = lambda *words: reduce(or_, (F.contains(t, F.lit(w)) for w in words))
    day, month = has("天", "日"), has("月")
    ranged = day & has("-", "~", "到", "至")
    # no pattern runs over a text without the words that it needs
    return {
        "span": of(ranged, span, 1), "until": of(ranged, span, 2), "day": of(day, rf"(?U){LEAD_NUMBER}{days}", 1),
        "week": of(has("周", "期"), rf"(?U){LEAD_NUMBER}{s}(?:个)?(?:星期|周)", 1), "half": of(month, "半(?:个)?月", 0), "month": of(month, rf"(?U){LEAD_NUMBER}{s}(?:个)?月", 1),
    }


def term_days(c: Column, found: dict[str, Column]) -> Column:
    """Days of the term c from what its forms find; the first form that fits counts."""
    out = F.when(c.rlike(IN_STOCK), 0).when(found["span"] != "", F.greatest(chinese_int(found["span"]), chinese_int(found["until"])))
    for form, days in (("day", 1), ("week", 7)):
        out = out.when(found[form] != "", chinese_int(found[form]) * days)
    return out.when(found["half"] != "", 15).when(found["month"] != "", chinese_int(found["month"]) * 30).cast("int")


def parse_lead_time(c: Column) -> Column:
    """Days of a delivery term, the larger of a range; null if it can't be told. The first form that fits counts."""
    return term_days(c, lead_numbers(lead_term(c)))


def _folded(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), "×*＊", "xxx"), rf"(?U){SPACE}+", "")


def normalize_text(c: Column) -> Column:
    """Full width to ASCII, lower case, × and * to x, no white space. Exact for texts whose NFKC form differs in width only."""
    return _folded(F.translate(F.coalesce(c, F.lit("")), _WIDE, _NARROW))


def normalize_nfkc(c: Column) -> Column:
    """normalize_text for any text; runs NFKC in Arrow batches, so give it distinct texts."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return _folded(nfkc(F.coalesce(c, F.lit(""))))


def item_key(name: Column, spec: Column, normalize=normalize_text) -> Column:
    return F.concat(normalize(name), F.lit("|"), normalize(spec))


def display_text(name: Column, spec: Column) -> Column:
    return strip(F.concat(name, F.lit(" "), spec))


def provenance(c: Column) -> Column:
    """A text without white space and the bars of tables."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f|]+", "")


def general(c: Column) -> Column:
    """A double with six significant digits and no trailing zeros, in exponent form below 1e-4 and from 1e6 on."""

    def parts(e: Column) -> Column:
        digits = F.regexp_replace(F.translate(F.regexp_extract(e, r"^-?([0-9.]+)e", 1), ".", ""), "(?<=.)0+$", "")
        return F.struct(F.regexp_extract(e, "^-?", 0).alias("sign"), F.regexp_extract(e, r"e([-+][0-9]+)$", 1).cast("int").alias("exponent"), digits.alias("digits"))

    def text(p: Column) -> Column:
        exponent, digits = p["exponent"], p["digits"]
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        plain = F.concat(F.substring(F.rpad(digits, 6, "0"), F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(9)))
        power = F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 9), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
        shown = F.when(exponent.between(-4, -1), small).when(exponent.between(0, 5), plain).otherwise(power)
        return F.concat(p["sign"], F.regexp_replace(shown, r"\.(?=e|$)", ""))

    # lambdas, so that each step is made once
    return F.when(c == 0, "0").otherwise(F.element_at(F.transform(F.transform(F.array(F.format_string("%.5e", c)), parts), text), 1))


def signed(c: Column) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise(""), general(c))


def quoted(c: Column) -> Column:
    """A text in quotes, control characters and the quote escaped."""
    plain = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def tokens(normal: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normal, F.lit("[a-z0-9]+"), F.lit(0)))


def digit_tokens(normal: Column) -> Column:
    return F.filter(tokens(normal), lambda t: t.rlike("[0-9]"))


def cjk_grams(normal: Column, n: int = 3) -> Column:
    """Distinct runs of n ideographs, over all ideographs of the text put together."""
    run = F.array_join(F.regexp_extract_all(normal, F.lit(CJK), F.lit(0)), "")
    starts = F.sequence(F.lit(1), F.greatest(F.length(run) - (n - 1), F.lit(1)))
    return F.when(F.length(run) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(run, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def likely_same(a: Column, b: Column) -> Column:
    """Whether two normal texts may name one item: one holds the other, they share a token with a digit, or three ideographs."""
    holds = ((F.length(a) >= 2) & F.contains(b, a)) | ((F.length(b) >= 2) & F.contains(a, b))
    return holds | F.arrays_overlap(digit_tokens(a), digit_tokens(b)) | F.arrays_overlap(cjk_grams(a), cjk_grams(b))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r'[\\/:*?"<>|]', "_")


def is_supplement(c: Column) -> Column:
    return c.rlike(SUPPLEMENT).cast("int")
