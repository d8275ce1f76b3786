"""The engine's queries over the star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare as C
from ..operators import extraction as X
from ..sources import files as S
from ..sources import testdata as D
from ..streaming.latest import append_available, latest_in_windows, latest_of_files, lines_of_files
from ..workspace import checkpointed, scratch, stored
from . import reports as P
from . import rules as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Suppliers that are sent to all executors at most.
SENT_SUPPLIERS = 100_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _merged(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The merged lines with the fields that a query needs, so that no others pass the merge. D.ORDER is total without them."""
    return C.merge_last(C.keyed(D.quote_lines(spark, sf_dir)).select("supplier_name", "item_key", *D.ORDER, *fields), D.ORDER)


def _checked(spark: SparkSession, sf_dir: str, *rules: str) -> DataFrame:
    return R.apply_rules(D.raw_lines(spark, sf_dir), rules=[r for r in R.RULES if r[0] in rules] if rules else R.RULES)


def _cents(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# --- sources and texts -------------------------------------------------------------------------------------


@query("""SELECT page_id, CASE WHEN ext IN ('.xlsx', '.xls') THEN 'excel' WHEN ext IN ('.txt', '.md', '.eml', '.csv') THEN 'text' WHEN ext IN ('.jpg', '.jpeg', '.png') THEN 'image' WHEN ext = '.pdf' THEN 'pdf' ELSE 'unsupported' END AS kind
FROM (SELECT page_id, lower(regexp_extract(regexp_extract(url, '[^/]*$') || CASE page_id % 6 WHEN 0 THEN '.XLSX' WHEN 1 THEN '.txt' WHEN 2 THEN '.Jpeg' WHEN 3 THEN '.pdf' WHEN 4 THEN '.csv' ELSE '.docx' END, '[^.]([.][^./]+)$', 1)) AS ext FROM pages)""")
def classify_files(spark, sf_dir):
    """S2 over page names with suffixes."""
    ends = F.element_at(F.array(*map(F.lit, (".XLSX", ".txt", ".Jpeg", ".pdf", ".csv", ".docx"))), (F.col("page_id") % 6 + 1).cast("int"))
    rows = D.table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "[^/]*$", 0), ends).alias("file"))
    return rows.select("page_id", S.kind_of(F.col("file")).alias("kind"))


@query("""WITH RECURSIVE pieces AS (
  SELECT doc_id, i AS n, parts[i] || CASE WHEN i < len(parts) THEN chr(10) ELSE '' END AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) p, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u
), lines AS (SELECT doc_id, n, line, length(line) AS size FROM pieces WHERE line <> '' OR n = 1
), walk AS (
  SELECT doc_id, n, line, size, 0 AS chunk_no FROM lines WHERE n = 1
  UNION ALL SELECT l.doc_id, l.n, l.line, CASE WHEN w.size + l.size > 2000 THEN l.size ELSE w.size + l.size END, CASE WHEN w.size + l.size > 2000 THEN w.chunk_no + 1 ELSE w.chunk_no END
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.n = w.n + 1
), chunks AS (SELECT doc_id, chunk_no, string_agg(line, '' ORDER BY n) AS chunk FROM walk GROUP BY doc_id, chunk_no)
SELECT doc_id, chunk_no, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_chunks, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS chunk_md5 FROM chunks""")
def text_chunks(spark, sf_dir):
    """L1 over documents: lines packed into chunks of 2,000 characters."""
    rows = X.chunk_texts(D.table(spark, sf_dir, "documents").select("doc_id", "text"), 2000, "doc_id", "text")
    return rows.select("doc_id", "chunk_no", "n_chunks", F.length("chunk").alias("n_chars"), F.md5(F.encode("chunk", "UTF-8")).alias("chunk_md5"))


@query(r"""SELECT doc_id, snippet = '' OR NOT contains(regexp_replace(text, '[\s|]+', '', 'g'), regexp_replace(snippet, '[\s|]+', '', 'g')) AS h1
FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN substr(text, 11, 30) || '~~no such words~~' ELSE substr(text, 11, 40) END AS snippet FROM documents)""")
def h1_provenance(spark, sf_dir):
    """Snippets held against whole texts."""
    docs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_file"), F.col("text").alias("raw_text"), "doc_id")
    snippet = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("raw_text", 11, 30), F.lit("~~no such words~~"))).otherwise(F.substring("raw_text", 11, 40))
    lines = docs.select("source_file", "doc_id", snippet.alias("source_snippet"), F.lit("high").alias("confidence"), F.array().cast("array<string>").alias("flags"))
    raw = docs.select("source_file", "raw_text", F.array().cast("array<string>").alias("low_ocr_lines"))
    return R.check_snippets(lines, raw).select("doc_id", "h1")


@query(r"""SELECT doc_id, poor AS ocr_low, CASE WHEN poor OR lost THEN 'low' ELSE 'high' END AS confidence, concat_ws(',', CASE WHEN lost THEN 'H1' END, CASE WHEN poor THEN 'OCR' END) AS flags FROM (
  SELECT doc_id, snippet <> '' AND doc_id % 4 = 0 AND low <> '' AND (contains(low, snippet) OR contains(snippet, low)) AS poor, raw = '' OR NOT contains(whole, snippet) AS lost FROM (
    SELECT doc_id, snippet AS raw, regexp_replace(text, '[\s|]+', '', 'g') AS whole, regexp_replace(snippet, '[\s|]+', '', 'g') AS snippet, regexp_replace(substr(text, 1, 30), '[\s|]+', '', 'g') AS low
    FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '~~no such words~~' WHEN 1 THEN substr(text, 6, 8) ELSE substr(text, 25, 40) END AS snippet FROM documents)))""")
def ocr_provenance(spark, sf_dir):
    """Snippets held against lines that were read badly."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source_file"), F.col("text").alias("raw_text"))
    snippet = F.when(F.col("doc_id") % 3 == 0, "~~no such words~~").when(F.col("doc_id") % 3 == 1, F.substring("raw_text", 6, 8)).otherwise(F.substring("raw_text", 25, 40))
    lines = docs.select("source_file", "doc_id", snippet.alias("source_snippet"), F.lit("high").alias("confidence"), F.array().cast("array<string>").alias("flags"))
    raw = docs.select("source_file", "raw_text", F.when(F.col("doc_id") % 4 == 0, F.array(F.substring("raw_text", 1, 30))).alias("low_ocr_lines"))
    return R.check_snippets(lines, raw).select("doc_id", "ocr_low", "confidence", F.array_join("flags", ",").alias("flags"))


#: Price lists made of parts: a file's answers come in two chunks, some chunks fail, some lines aren't valid.
_LISTS = """parts AS (SELECT p_partkey % 200 AS f, (p_partkey // 200) % 2 AS c, p_partkey, p_name, p_size % 10 <> 0 AS ok FROM part),
files AS (SELECT f, f % 17 = 0 AS blank, f % 13 = 5 AS failed, CASE WHEN f % 5 IN (0, 1) THEN 'Second ' || f ELSE 'Vendor ' || f END AS supplier FROM range(200) r(f))"""


def _price_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = spark.range(200).select(F.col("id").alias("f"))
    name = F.concat(F.lit("list-"), F.col("f").cast("string"), F.lit(".txt"))
    raw = files.select(name.alias("source_file"), F.lit("text").alias("kind"), F.when(F.col("f") % 17 == 0, " ").otherwise("x").alias("raw_text"), F.array().cast("array<string>").alias("extraction_warnings"))
    pa = D.table(spark, sf_dir, "part").select((F.col("p_partkey") % 200).alias("f"), (F.floor(F.col("p_partkey") / 200) % 2).alias("c"), "p_partkey", "p_name", F.when(F.col("p_size") % 10 == 0, "mid").otherwise("high").alias("confidence"))
    line = F.struct("p_partkey", F.col("p_name").alias("item_name"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("unit_price_raw"), "confidence")
    own = pa.groupBy("f", "c").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    chunks = files.filter("f % 17 != 0").withColumn("c", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))).join(own, ["f", "c"], "left")
    number = F.col("f").cast("string")
    supplier = F.when(F.col("c") == 1, F.concat(F.lit("Second "), number)).when(F.col("f") % 5 == 0, "").when(F.col("f") % 5 == 1, X.UNKNOWN_SUPPLIER).otherwise(F.concat(F.lit("Vendor "), number))
    lines = F.transform(F.coalesce("lines", F.array().cast("array<struct<p_partkey:bigint,item_name:string,unit_price_raw:string,confidence:string>>")), lambda x: x.dropFields("p_partkey"))
    lost = (F.col("f") % 13 == 5) & (F.col("c") == 1)
    answer = F.to_json(F.struct(supplier.alias("supplier_name"), lines.alias("lines")))
    return raw, chunks.select(name.alias("source_file"), F.col("c").cast("int").alias("chunk_no"), F.when(~lost, answer).alias("answer"), F.when(lost, "no answer").alias("error"))


@query(f"""WITH {_LISTS} SELECT 'list-' || f || '.txt' AS source_file, CAST(row_number() OVER (PARTITION BY f ORDER BY c, p_partkey) AS INTEGER) AS line_no, supplier AS supplier_name, p_name AS item_name, 'P' || p_partkey AS unit_price_raw
FROM parts JOIN files USING (f) WHERE ok AND NOT blank AND NOT failed""")
def parsed_lines(spark, sf_dir):
    """The lines of answers in chunks."""
    _, lines = X.parse_files(*_price_lists(spark, sf_dir))
    return lines.select("source_file", "line_no", "supplier_name", "item_name", "unit_price_raw")


@query(f"""WITH {_LISTS}, bad AS (SELECT f, count(*) AS n FROM parts WHERE NOT ok GROUP BY f)
SELECT 'list-' || f || '.txt' AS source_file, CASE WHEN blank OR failed THEN '未知供应商' ELSE supplier END AS supplier_name, CAST(CASE WHEN blank THEN 1 WHEN failed THEN 2 ELSE 1 + coalesce(n, 0) END AS INTEGER) AS n_warnings,
  failed AND NOT blank AS failed FROM files LEFT JOIN bad USING (f)""")
def parsed_quotes(spark, sf_dir):
    """Suppliers and warnings of files by their answers."""
    quotes, _ = X.parse_files(*_price_lists(spark, sf_dir))
    return quotes.select("source_file", "supplier_name", F.size("warnings").alias("n_warnings"), P.failed("warnings").alias("failed"))


@query("""SELECT page_id, substr(sha256('{"messages": [{"content": "s", "role": "system"}, {"content": "page ' || page_id || '", "role": "user"}], "rf": null}'), 1, 16) AS request,
  CASE WHEN page_id % 3 <> 0 THEN '{"n": ' || page_id || '}' END AS answer, page_id % 3 = 0 AS lost FROM pages""")
def replayed_answers(spark, sf_dir):
    """Answers from recordings, joined by the request's key."""
    prompts = D.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("prompt"))
    recorded = F.substring(F.sha2(F.encode(F.concat(F.lit('{"messages": [{"content": "s", "role": "system"}, {"content": "'), "prompt", F.lit('", "role": "user"}], "rf": null}')), "UTF-8"), 256), 1, 16)
    recordings = prompts.filter("page_id % 3 != 0").select(recorded.alias("request"), F.concat(F.lit('{"n": '), F.col("page_id").cast("string"), F.lit("}")).alias("answer"))
    rows = X.replayed(prompts, recordings, "s", "n", {}, "none")
    return rows.select("page_id", "request", "answer", F.col("error").isNotNull().alias("lost"))


@query("""SELECT user_id, count(*) AS n_lines, count(*) FILTER (WHERE value / 100 < 0.85) AS n_low, count(*) FILTER (WHERE value / 100 < 0.85) > 0 AS has_low FROM events GROUP BY user_id""")
def ocr_low_lines(spark, sf_dir):
    """Lines read with a score under the threshold, a file for each user."""
    low = S.is_low(F.col("value") / 100)
    rows = D.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_lines"), F.count_if(low).alias("n_low"))
    return rows.withColumn("has_low", F.col("n_low") > 0)


@query("SELECT doc_id, regexp_matches(text, '[0-9][OIl]|[OIl][0-9]') AS confused FROM documents")
def ocr_confusion(spark, sf_dir):
    """F4."""
    return D.table(spark, sf_dir, "documents").select("doc_id", T.ocr_confusion(F.col("text")).alias("confused"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)HK\$|HKD|港币|港元') THEN 'HKD' WHEN regexp_matches(text, '(?i)\$|USD|美元|美金') THEN 'USD' WHEN regexp_matches(text, '(?i)€|EUR|欧元') THEN 'EUR' END AS currency FROM documents""")
def currency_detect(spark, sf_dir):
    """F5."""
    return D.table(spark, sf_dir, "documents").select("doc_id", T.detect_currency(F.col("text")).alias("currency"))


@query("""WITH named AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '，云川仪器有限公司，远桥商贸有限公司' WHEN 1 THEN '，云川仪器有限公司，云川仪器有限公司' WHEN 2 THEN '，海棠轴件销售部，清林工厂。' ELSE '' END AS tail FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '云川仪器有限公司、远桥商贸有限公司' ELSE '海棠轴件销售部、清林工厂' END AS names FROM named WHERE doc_id % 4 IN (0, 2)""")
def supplier_consistency(spark, sf_dir):
    """V7 over documents with company names behind them."""
    tail = F.element_at(F.array(*map(F.lit, ("，云川仪器有限公司，远桥商贸有限公司", "，云川仪器有限公司，云川仪器有限公司", "，海棠轴件销售部，清林工厂。", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    raw = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), F.concat("text", tail).alias("raw_text"))
    return R.supplier_names(raw).select(F.col("source_file").alias("doc_id"), F.array_join("names", "、").alias("names"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN 'V7' ELSE '' END AS flags, CASE doc_id % 4 WHEN 0 THEN '同一文件出现多个供应商名称: 云川仪器有限公司、远桥商贸有限公司，整个文件标黄待人工确认' WHEN 2 THEN '同一文件出现多个供应商名称: 海棠轴件销售部、清林工厂，整个文件标黄待人工确认' END AS message FROM documents""")
def supplier_flags(spark, sf_dir):
    """V7: the flag of the lines and the finding of files that name several suppliers."""
    tail = F.element_at(F.array(*map(F.lit, ("，云川仪器有限公司，远桥商贸有限公司", "，云川仪器有限公司，云川仪器有限公司", "，海棠轴件销售部，清林工厂。", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    raw = checkpointed(D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), F.concat("text", tail).alias("raw_text")))
    lines = raw.select("source_file", F.array().cast("array<string>").alias("flags"))
    found = R.supplier_findings(raw).select("source_file", "message")
    return R.flag_suppliers(lines, raw).join(found, "source_file", "left").select(F.col("source_file").alias("doc_id"), F.array_join("flags", ",").alias("flags"), "message")


@query(r"""WITH named AS (SELECT p_partkey, array_to_string(regexp_extract_all(translate(lower(p_name), 'abcdefghij', '甲乙丙丁戊己庚辛壬癸'), '[\x{4e00}-\x{9fff}]+'), '') AS run FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct([substr(run, i, 3) for i in range(1, greatest(length(run) - 1, 1))])), ' ') AS grams FROM named""")
def ideograph_runs(spark, sf_dir):
    """runs of three ideographs, from names whose letters are made ideographs."""
    name = F.translate(F.lower("p_name"), "abcdefghij", "甲乙丙丁戊己庚辛壬癸")
    return D.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(T.cjk_grams(T.normalize_text(name))), " ").alias("grams"))


@query(r"SELECT p_partkey, regexp_replace(lower(p_name), '\s+', '', 'g') || '|' || regexp_replace(lower(p_type || ' ' || p_size || 'x' || p_size), '\s+', '', 'g') AS item_key FROM part")
def normalize_key(spark, sf_dir):
    """F6, F7."""
    spec = F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit("×"), F.col("p_size").cast("string"))
    return D.table(spark, sf_dir, "part").select("p_partkey", T.item_key(F.col("p_name"), spec).alias("item_key"))


# --- rules -------------------------------------------------------------------------------------------------


@query(f"WITH {D.SQL_RAW} SELECT source_file, line_no, quantity, unit_price FROM parsed")
def parse_number(spark, sf_dir):
    """F1, V2."""
    return _checked(spark, sf_dir, "V2").select("source_file", "line_no", "quantity", "unit_price")


@query(f"WITH {D.SQL_RAW} SELECT source_file, line_no, CAST(days AS INTEGER) AS lead_time_days FROM parsed")
def parse_lead_time(spark, sf_dir):
    """F2, F3, V5."""
    return _checked(spark, sf_dir, "V5").select("source_file", "line_no", "lead_time_days")


@query(f"WITH {D.SQL_RAW} SELECT source_file, line_no, '必填字段缺失: ' || CASE WHEN item_name = ' ' AND unit_price_raw = '' THEN '物料名称、单价' WHEN item_name = ' ' THEN '物料名称' ELSE '单价' END AS message FROM raw WHERE item_name = ' ' OR unit_price_raw = ''")
def required_fields(spark, sf_dir):
    """V1."""
    return R.findings(_checked(spark, sf_dir, "V1")).filter("rule = 'V1'").select("source_file", "line_no", "message")


@query(f"""WITH {D.SQL_RAW} SELECT source_file, line_no, quantity, unit_price, amount, CASE WHEN amount = 0 THEN quantity * unit_price <> 0 ELSE abs(quantity * unit_price - amount) > 0.02 * abs(amount) END AS mismatch
FROM parsed WHERE amount IS NOT NULL AND unit_price IS NOT NULL""")
def amount_check(spark, sf_dir):
    """V3: lines whose amount can be checked."""
    rows = _checked(spark, sf_dir, "V2", "V3").withColumn("amount", T.parse_number(F.col("amount_raw"))).filter("amount is not null and quantity is not null and unit_price is not null")
    return rows.select("source_file", "line_no", "quantity", "unit_price", "amount", F.array_contains("flags", "V3").alias("mismatch"))


@query(f"""WITH {D.SQL_RAW} SELECT source_file, line_no, CASE WHEN line_no = 3 THEN 'USD' ELSE 'CNY' END AS currency,
CASE WHEN remark = '不含税' THEN false WHEN remark = '含税' OR line_no = 4 THEN true END AS tax_included FROM raw""")
def tax_tristate(spark, sf_dir):
    """V4."""
    return _checked(spark, sf_dir, "V4").select("source_file", "line_no", "currency", "tax_included")


@query(f"WITH {D.SQL_RAW} SELECT source_file, line_no, CASE unit WHEN ' PCS' THEN '件' WHEN 'Sets' THEN '套' ELSE unit END AS unit FROM raw")
def unit_normalize(spark, sf_dir):
    """V6."""
    return _checked(spark, sf_dir, "V6").select("source_file", "line_no", "unit")


_G = "printf('%g', {0})"


@query(f"""WITH {D.SQL_RAW}, found AS (
  SELECT source_file, line_no, 'V1' AS rule, '必填字段缺失: ' || CASE WHEN item_name = ' ' AND unit_price_raw = '' THEN '物料名称、单价' WHEN item_name = ' ' THEN '物料名称' ELSE '单价' END AS message FROM raw WHERE item_name = ' ' OR unit_price_raw = ''
  UNION ALL SELECT source_file, line_no, 'V2', '单价疑似 OCR 字符混淆（0/O、1/I/l），解析值需人工核对: ''' || unit_price_raw || '''' FROM raw WHERE line_no = 5
  UNION ALL SELECT source_file, line_no, 'V2', '单价无法解析为数值（保留原文）: ''' || unit_price_raw || '''' FROM raw WHERE line_no = 6
  UNION ALL SELECT source_file, line_no, 'V3', '金额不符: ' || {_G.format('quantity')} || '×' || {_G.format('unit_price')} || '=' || {_G.format('quantity * unit_price')} || ' ≠ 报价金额 ' || {_G.format('amount')}
    || '（差额 ' || CASE WHEN quantity * unit_price - amount >= 0 THEN '+' ELSE '' END || {_G.format('quantity * unit_price - amount')} || '）'
    FROM parsed WHERE amount IS NOT NULL AND unit_price IS NOT NULL AND CASE WHEN amount = 0 THEN quantity * unit_price <> 0 ELSE abs(quantity * unit_price - amount) > 0.02 * abs(amount) END
  UNION ALL SELECT source_file, line_no, 'V4', '原文币种疑似 USD，与标记 CNY 不一致（已改为 USD，未做换算）' FROM raw WHERE line_no = 3
  UNION ALL SELECT source_file, line_no, 'V5', '交期无法解析为天数（保留原文）: ''尽快''' FROM raw WHERE line_no = 7
) SELECT source_file, rule, source_file || '#行' || line_no AS target, message FROM found""")
def findings_union(spark, sf_dir):
    """V1 to V6: all findings of all lines."""
    return R.findings(_checked(spark, sf_dir)).select("source_file", "rule", "target", "message")


# --- comparison --------------------------------------------------------------------------------------------


@query(f"WITH {D.SQL_MERGED} SELECT supplier_name, item_key, source_file, line_no, unit_price, quantity, CAST(lead_time_days AS INTEGER) AS lead_time_days FROM merged")
def merge_last_wins(spark, sf_dir):
    """W1, F13."""
    return _merged(spark, sf_dir, "unit_price", "quantity", "lead_time_days").select("supplier_name", "item_key", "source_file", "line_no", "unit_price", "quantity", "lead_time_days")


@query(f"""WITH {D.SQL_LINES}, noted AS (SELECT *, lag(source_file) OVER (PARTITION BY supplier_name, item_key ORDER BY {D.SQL_ORDER}) AS replaced FROM lines)
SELECT supplier_name, item_key, supplier_name || ': ' || item_name || ' 以 ' || source_file || ' 覆盖 ' || replaced AS note FROM noted WHERE replaced IS NOT NULL""")
def merge_notes(spark, sf_dir):
    """What replaces what."""
    return C.merge_notes(C.keyed(D.quote_lines(spark, sf_dir)), D.ORDER).select("supplier_name", "item_key", "note")


def _placed(merged: DataFrame) -> DataFrame:
    """merged with supplier_ord. The suppliers are sent to the lines while they are few; left to itself, Spark sends the lines if these are packed well."""
    suppliers = checkpointed(C.supplier_order(merged))
    return merged.join(suppliers.hint("broadcast" if suppliers.count() <= SENT_SUPPLIERS else "merge"), "supplier_name")


@query(f"""WITH {D.SQL_LINES}, firsts AS (SELECT supplier_name, item_key, {D.SQL_ORDER}, item_name, spec, row_number() OVER (PARTITION BY supplier_name, item_key ORDER BY {D.SQL_ORDER}) AS r1,
  row_number() OVER (PARTITION BY supplier_name ORDER BY {D.SQL_ORDER}) AS r2 FROM lines), suppliers AS (
  SELECT supplier_name, row_number() OVER (ORDER BY {D.SQL_ORDER}, supplier_name) AS o FROM firsts WHERE r2 = 1), entries AS (
  SELECT f.*, s.o, row_number() OVER (PARTITION BY item_key ORDER BY s.o) AS r3, count(*) OVER (PARTITION BY item_key) AS n_entries FROM firsts f JOIN suppliers s USING (supplier_name) WHERE r1 = 1)
SELECT item_key, supplier_name AS first_supplier, n_entries FROM entries WHERE r3 = 1""")
def first_pass_groups(spark, sf_dir):
    """J3, W3."""
    return C.first_groups(_placed(stored(_merged(spark, sf_dir, "item_name", "spec").select("supplier_name", "item_key", "item_name", "spec", "first_ord")))).select("item_key", "first_supplier", "n_entries")


def _part_match(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    merged = checkpointed(_placed(stored(C.merge_last(C.keyed(D.part_quotes(spark, sf_dir))))))
    groups = checkpointed(C.first_groups(merged))
    return merged, groups, C.candidate_pairs(merged, groups)


_PARTS = r"""q AS (
  SELECT 'S' || p_partkey % 10 AS supplier, p_partkey, p_name || ' ' || p_type || '/' || p_size || 'x' || regexp_extract(p_brand, '[0-9]+') AS text,
    regexp_replace(lower(p_name), '\s+', '', 'g') || '|' || regexp_replace(lower(p_type || '/' || p_size || 'x' || regexp_extract(p_brand, '[0-9]+')), '\s+', '', 'g') AS k FROM part
), g AS (
  SELECT k, min(text) AS text, regexp_replace(lower(min(text)), '\s+', '', 'g') AS n, count(DISTINCT supplier) AS n_entries, list(DISTINCT supplier) AS suppliers FROM q GROUP BY k
), t AS (SELECT k, unnest(list_distinct(list_filter(regexp_extract_all(n, '[a-z0-9]+'), lambda x: regexp_matches(x, '[0-9]')))) AS tok FROM g
), met AS (
  SELECT o.k AS ok, r.k AS gk FROM t o JOIN t r ON o.tok = r.tok AND o.k <> r.k
  UNION SELECT o.k, r.k FROM g o JOIN g r ON o.k <> r.k AND o.n_entries = 1 AND (contains(r.n, o.n) OR contains(o.n, r.n))
), pairs AS (
  SELECT DISTINCT least(ok, gk) AS lo, greatest(ok, gk) AS hi FROM met JOIN g o ON o.k = ok JOIN g r ON r.k = gk
  WHERE o.n_entries = 1 AND NOT list_has_any(o.suppliers, r.suppliers)
)"""


@query(f"WITH {_PARTS} SELECT lo, hi FROM pairs")
def candidate_pairs(spark, sf_dir):
    """Which pairs are met, without their orientation."""
    _, _, pairs = _part_match(spark, sf_dir)
    return pairs.select(F.least("a_key", "b_key").alias("lo"), F.greatest("a_key", "b_key").alias("hi"))


def _results(pairs: DataFrame) -> DataFrame:
    """Made-up answers: two pairs in three are the same, every other one of them surely."""
    n = F.col("pair_id").cast("long")
    return pairs.select(F.col("pair_id").alias("id"), (n % 3 != 0).alias("same"), F.when(n % 2 == 0, "high").otherwise("low").alias("confidence"), F.lit("规格一致").alias("reason"), n.alias("ord"))


@query()
def match_fold(spark, sf_dir):
    """M1, J5, W8 over the parts' pairs."""
    _, groups, pairs = _part_match(spark, sf_dir)
    pairs = C.numbered(pairs.drop("a_text", "b_text"))
    return C.match_fold(groups, pairs, _results(pairs)).select("item_key", "final_key", "group_ord", "review", "n_notes")


@query(f"WITH {_PARTS} SELECT k AS item_key, true AS review, count(*) AS n_notes FROM (SELECT lo AS k FROM pairs UNION ALL SELECT hi FROM pairs) GROUP BY k")
def match_degrade(spark, sf_dir):
    """M2."""
    _, _, pairs = _part_match(spark, sf_dir)
    return C.match_degraded(pairs)


@query(f"""WITH {D.SQL_MERGED}, entries AS (SELECT *, item_name AS group_key FROM merged), best AS (
  SELECT *, row_number() OVER (PARTITION BY group_key, supplier_name ORDER BY is_supplement DESC, source_file DESC, spec DESC) AS rn, count(*) OVER (PARTITION BY group_key, supplier_name) AS n_seen FROM entries)
SELECT group_key, supplier_name, source_file, n_seen FROM best WHERE rn = 1""")
def group_dedupe(spark, sf_dir):
    """W2 with groups by item name."""
    rows = _merged(spark, sf_dir, "item_name", "spec").select(F.col("item_name").alias("group_key"), "supplier_name", "is_supplement", "source_file", F.col("spec").alias("entry_ord"))
    return C.dedupe_in_group(rows).select("group_key", "supplier_name", "source_file", "n_seen")


@query(f"""WITH {D.SQL_MERGED}, ranked AS (SELECT *, is_supplement || source_file AS r, max(is_supplement || source_file) OVER (PARTITION BY item_name, supplier_name ORDER BY spec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM merged)
SELECT item_name AS group_key, supplier_name, supplier_name || ': ' || item_name || ' 以 ' || CASE WHEN r >= best THEN source_file ELSE substr(best, 2) END || ' 覆盖 ' || CASE WHEN r >= best THEN substr(best, 2) ELSE source_file END AS note FROM ranked WHERE best IS NOT NULL""")
def group_dedupe_notes(spark, sf_dir):
    """Which file replaces which inside a group."""
    rows = _merged(spark, sf_dir, "item_name", "spec").select(F.col("item_name").alias("group_key"), F.col("item_name").alias("group_name"), "supplier_name", "is_supplement", "source_file", F.col("spec").alias("entry_ord"))
    return C.dedupe_notes(rows).select("group_key", "supplier_name", "note")


@query(f"WITH {D.SQL_STATS} SELECT item_key, n_entries, n_priced, min_price, max_price, round(avg_price, 6) AS avg_price FROM stats")
def price_stats(spark, sf_dir):
    """A1."""
    return C.group_stats(_merged(spark, sf_dir, "unit_price", "lead_time_days")).select("item_key", "n_entries", "n_priced", "min_price", "max_price", *_cents("avg_price"))


@query(f"WITH {D.SQL_CELLS} SELECT item_key, supplier_name, round(deviation, 6) AS deviation FROM cells")
def price_deviation(spark, sf_dir):
    """A2."""
    fields = ("unit_price", "lead_time_days", "confidence", "flags")
    merged = stored(_merged(spark, sf_dir, *fields).select("supplier_name", "item_key", *fields))
    return C.coloured(merged, C.group_stats(merged)).select("item_key", "supplier_name", *_cents("deviation"))


@query(f"WITH {D.SQL_STATS} SELECT item_key, n_leads, CAST(min_lead_days AS INTEGER) AS min_lead_days, CAST(max_lead_days AS INTEGER) AS max_lead_days, median_lead_days FROM stats")
def lead_stats(spark, sf_dir):
    """A3."""
    return C.group_stats(_merged(spark, sf_dir, "unit_price", "lead_time_days")).select("item_key", "n_leads", "min_lead_days", "max_lead_days", "median_lead_days")


@query(f"WITH {D.SQL_CELLS} SELECT item_key, supplier_name FROM gray")
def missing_quotes(spark, sf_dir):
    """J6."""
    return C.missing_quotes(_merged(spark, sf_dir))


@query(f"""WITH {D.SQL_CELLS} SELECT item_key, supplier_name, unit_price, quantity, CAST(lead_time_days AS INTEGER) AS lead_time_days, confidence, round(deviation, 6) AS deviation, price_color, lead_color, false AS missing FROM cells
UNION ALL SELECT item_key, supplier_name, NULL, NULL, NULL, NULL, NULL, 'D9D9D9', 'D9D9D9', true FROM gray""")
def compare_matrix(spark, sf_dir):
    """X1, X2 in long form: the comparison sheet."""
    fields = ("unit_price", "quantity", "lead_time_days", "confidence", "flags")
    return C.matrix(stored(_merged(spark, sf_dir, *fields).select("supplier_name", "item_key", *fields))).select("item_key", "supplier_name", "unit_price", "quantity", "lead_time_days", "confidence", *_cents("deviation"), "price_color", "lead_color", "missing")


_FIVE = [f"Supplier#{i:09d}" for i in range(5)]


@query(f"WITH {D.SQL_MERGED} SELECT item_key, " + ", ".join(f"max(unit_price) FILTER (WHERE supplier_name = '{s}') AS s{i}_price, max(lead_time_days) FILTER (WHERE supplier_name = '{s}')::INTEGER AS s{i}_lead" for i, s in enumerate(_FIVE)) + " FROM merged GROUP BY item_key")
def matrix_pivot(spark, sf_dir):
    """Columns for five suppliers."""
    return P.pivot_suppliers(_merged(spark, sf_dir, "unit_price", "lead_time_days"), _FIVE)


@query(f"""WITH {D.SQL_RAW}, f AS (SELECT *, concat_ws(',', CASE WHEN item_name = ' ' OR unit_price_raw = '' THEN 'V1' END, CASE WHEN line_no IN (5, 6) THEN 'V2' END,
  CASE WHEN amount IS NOT NULL AND unit_price IS NOT NULL AND CASE WHEN amount = 0 THEN quantity * unit_price <> 0 ELSE abs(quantity * unit_price - amount) > 0.02 * abs(amount) END THEN 'V3' END, CASE WHEN line_no = 7 THEN 'V5' END) AS flags FROM parsed)
SELECT source_file, line_no, item_name, quantity, unit_price, CASE WHEN remark = '不含税' THEN '未税' WHEN remark = '含税' OR line_no = 4 THEN '含税' ELSE '' END AS tax, flags, flags <> '' AS yellow FROM f""")
def detail_rows(spark, sf_dir):
    """P5, P7, X3."""
    return P.detail(_checked(spark, sf_dir).withColumn("supplier_name", F.lit(""))).select("source_file", "line_no", "item_name", "quantity", "unit_price", "tax", "flags", "yellow")


@query(f"""WITH {D.SQL_RAW}, f AS (SELECT *, concat_ws(',', CASE WHEN item_name = ' ' OR unit_price_raw = '' THEN 'V1' END, CASE WHEN line_no IN (5, 6) THEN 'V2' END,
  CASE WHEN amount IS NOT NULL AND unit_price IS NOT NULL AND CASE WHEN amount = 0 THEN quantity * unit_price <> 0 ELSE abs(quantity * unit_price - amount) > 0.02 * abs(amount) END THEN 'V3' END, CASE WHEN line_no = 7 THEN 'V5' END) AS flags FROM parsed)
SELECT source_file, line_no, 'S' || line_no AS supplier_name, item_name, '' AS spec, q || '件' AS quantity_raw, quantity, CASE unit WHEN ' PCS' THEN '件' WHEN 'Sets' THEN '套' ELSE unit END AS unit, unit_price_raw, unit_price, amount_raw,
  CASE WHEN line_no = 3 THEN 'USD' ELSE 'CNY' END AS currency, CASE WHEN remark = '不含税' THEN '未税' WHEN remark = '含税' OR line_no = 4 THEN '含税' ELSE '' END AS tax, lead_time_raw, CAST(days AS INTEGER) AS lead_time_days, '' AS payment_terms, remark,
  'high' AS confidence, flags, '' AS source_snippet FROM f""")
def detail_sheet(spark, sf_dir):
    """All columns of the long table."""
    rows = _checked(spark, sf_dir).withColumn("supplier_name", F.concat(F.lit("S"), F.col("line_no").cast("string")))
    return P.detail(rows).drop("yellow")


@query("""SELECT 'order-' || l_orderkey AS source_file, count(*) AS n_lines, CAST(max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) + max(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS INTEGER) AS n_warnings,
CASE WHEN max(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) = 1 THEN '失败' WHEN max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 THEN '警告' ELSE '正常' END AS status FROM lineitem GROUP BY l_orderkey""")
def file_stats(spark, sf_dir):
    """A file for each order, with made-up warnings."""
    quotes, lines = _order_files(spark, sf_dir)
    return P.file_stats(quotes, lines).select("source_file", "n_lines", "n_warnings", "status")


def _order_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = D.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("source_file"), "l_returnflag", "l_linenumber")
    warned = lines.groupBy("source_file").agg(F.max(F.col("l_returnflag") == "A").alias("w"), F.max(F.col("l_linenumber") == 7).alias("e"))
    warnings = F.array_compact(F.array(F.when(F.col("w"), F.lit("空文件")), F.when(F.col("e"), F.lit("LLM_FAILED: x"))))
    return warned.select("source_file", F.lit("text").alias("kind"), F.lit("").alias("supplier_name"), warnings.alias("warnings")), lines


@query("""SELECT count(DISTINCT l_orderkey) AS n_files, count(*) AS n_lines, count(DISTINCT l_orderkey) FILTER (WHERE l_linenumber = 7) AS n_failed FROM lineitem""")
def run_summary(spark, sf_dir):
    """The counts of a run."""
    quotes, lines = _order_files(spark, sf_dir)
    return P.summary(quotes, lines).select("n_files", "n_lines", "n_failed")


@query(f"""WITH {D.SQL_RAW} SELECT source_file, count(*) AS n_fields, count(*) FILTER (WHERE line_no IN (2, 3) AND l_returnflag = 'N') AS n_wrong_unflagged,
round(1 - count(*) FILTER (WHERE line_no IN (2, 3) AND l_returnflag = 'N') / count(*), 6) AS accuracy FROM parsed WHERE unit_price IS NOT NULL GROUP BY source_file""")
def field_accuracy(spark, sf_dir):
    """A10: prices against a copy in which some are changed; flagged ones don't count as wrong."""
    rows = _checked(spark, sf_dir, "V2").filter("unit_price is not null")
    wrong = F.col("line_no").isin(2, 3) & (F.col("amount_raw") == "")
    pairs = rows.select("source_file", (F.col("unit_price") + F.when(wrong, 1).otherwise(0)).alias("expected"), F.col("unit_price").alias("actual"), F.lit(False).alias("flagged"))
    out = P.accuracy(pairs, "source_file")
    return out.select("source_file", "n_fields", "n_wrong_unflagged", *_cents("accuracy"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_latest_quotes(spark, sf_dir):
    """The latest event of each user and type, by Structured Streaming."""
    schema = D.table(spark, sf_dir, "events").schema
    rows = latest_of_files(spark, f"{sf_dir}/events.parquet", schema, ("user_id", "event_type"), ("ts", "event_id"))
    return rows.select("user_id", "event_type", "event_id", "value")


@query(ORACLE_SQL["findings_union"])
def stream_findings(spark, sf_dir):
    """V1 to V6 over lines that come as a stream: the rules keep no state, and each file is checked once."""
    base = scratch(spark, "findings")
    lines = lines_of_files(spark, f"{sf_dir}/lineitem.parquet", D.table(spark, sf_dir, "lineitem").schema)
    append_available(R.findings(R.apply_rules(D.raw_lines_of(lines))), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("source_file", "rule", "target", "message")


@query("""WITH bounds AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), w AS (SELECT *, date_trunc('day', ts) AS window_start, row_number() OVER (PARTITION BY date_trunc('day', ts), user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT strftime(window_start, '%Y-%m-%d') AS day, user_id, event_id, value FROM w, bounds WHERE rn = 1 AND window_start + INTERVAL 1 DAY <= mark""")
def stream_daily_latest(spark, sf_dir):
    """The latest event of each user and day, of the days that the watermark has closed."""
    base, schema = scratch(spark, "daily"), D.table(spark, sf_dir, "events").schema
    rows = latest_in_windows(lines_of_files(spark, f"{sf_dir}/events.parquet", schema).withColumn("at", F.col("ts").cast("timestamp")), ("user_id",), ("ts", "event_id"), "at", "1 day", "1 day")
    append_available(rows, f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "user_id", "event_id", "value")
