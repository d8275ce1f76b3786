"""The star-schema tables seen as supplier quotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What makes the order of a supplier's lines total.
TIES = ("t_part", "t_price", "t_quantity", "t_ship", "t_rest")
ORDER = ("is_supplement", "source_file", "line_no", *TIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file() -> Column:
    return F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"), F.when(F.col("l_returnflag") == "R", "-补充").otherwise(""))


def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as parsed quotes: a file for each order, items by part name, type and size."""
    li = table(spark, sf_dir, "lineitem")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("supplier_name"))
    pa = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("item_name"), F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")).alias("spec"))
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    # the largest table first, while the lines are narrow; what brings along texts comes last
    rows = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).join(pa, F.col("l_partkey") == F.col("p_partkey")).join(su, F.col("l_suppkey") == F.col("s_suppkey"))
    days = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return rows.select(
        _file().alias("source_file"), F.col("l_linenumber").alias("line_no"), "supplier_name", "item_name", "spec",
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.when(days >= 0, days).alias("lead_time_days"),
        F.when(F.col("l_discount") >= 0.09, "low").otherwise("high").alias("confidence"), F.when(F.col("l_tax") >= 0.08, F.array(F.lit("V3"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.col("l_partkey").alias("t_part"), F.col("l_extendedprice").alias("t_price"), F.col("l_quantity").alias("t_quantity"), F.col("l_shipdate").alias("t_ship"),
        F.concat_ws("|", F.format_string("%.2f", "l_discount"), F.format_string("%.2f", "l_tax"), "l_linestatus").alias("t_rest"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_lines_of(table(spark, sf_dir, "lineitem"))


def raw_lines_of(lineitem: DataFrame) -> DataFrame:
    """Order lines, of a table or a stream, as unparsed quotes with the defects that the rules look for."""
    n, q, up = F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("long")
    text = lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    price = F.when(n == 1, text("¥", up)).when(n == 2, text(up, "块5")).when(n == 3, text("$", up)).when(n == 4, text(up, "元（含税13%）")).when(n == 5, text("l", up, "元")).when(n == 6, F.lit("面议")).otherwise(F.lit(""))
    lead = F.when(n == 1, text(q, "天")).when(n == 2, text(q, "-", q + 3, "天")).when(n == 3, F.lit("现货")).when(n == 4, text(q, "周")).when(n == 5, F.lit("十二天")).when(n == 6, F.lit("半个月")).otherwise(F.lit("尽快"))
    amount = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(text(F.floor("l_extendedprice").cast("long"), "元"))
    none = F.lit(None)
    return lineitem.select(
        _file().alias("source_file"), n.alias("line_no"), F.when(F.col("l_tax") == 0, F.lit(" ")).otherwise(text("item ", F.col("l_partkey"))).alias("item_name"), F.lit("").alias("spec"),
        text(q, "件").alias("quantity_raw"), none.cast("double").alias("quantity"), F.when(F.col("l_linestatus") == "O", " PCS").when(F.col("l_returnflag") == "A", "Sets").otherwise("托").alias("unit"),
        price.alias("unit_price_raw"), none.cast("double").alias("unit_price"), amount.alias("amount_raw"), F.lit("CNY").alias("currency"), none.cast("boolean").alias("tax_included"),
        lead.alias("lead_time_raw"), none.cast("int").alias("lead_time_days"), F.when(F.col("l_returnflag") == "A", "含税").when(F.col("l_returnflag") == "R", "不含税").otherwise("").alias("remark"),
        F.lit("").alias("payment_terms"), F.lit("high").alias("confidence"), F.lit("").alias("source_snippet"), F.array().cast("array<string>").alias("flags"),
    )


def part_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as quotes of ten suppliers, most items of one supplier only."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("list-"), (F.col("p_partkey") % 10).cast("string")).alias("source_file"), F.col("p_partkey").cast("int").alias("line_no"), F.concat(F.lit("S"), (F.col("p_partkey") % 10).cast("string")).alias("supplier_name"),
        F.col("p_name").alias("item_name"), F.concat("p_type", F.lit("/"), F.col("p_size").cast("string"), F.lit("x"), F.regexp_extract("p_brand", "[0-9]+", 0)).alias("spec"), F.col("p_retailprice").alias("unit_price"),
    )


#: The same in SQL.
SQL_LINES = """lines AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_supplement, 'order-' || l_orderkey || CASE WHEN l_returnflag = 'R' THEN '-补充' ELSE '' END AS source_file,
    l_linenumber AS line_no, s_name AS supplier_name, p_name AS item_name, p_type || ' ' || p_size AS spec, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
    CASE WHEN date_diff('day', o_orderdate, l_shipdate) >= 0 THEN date_diff('day', o_orderdate, l_shipdate) END AS lead_time_days,
    CASE WHEN l_discount >= 0.09 THEN 'low' ELSE 'high' END AS confidence, l_tax >= 0.08 AS flagged,
    l_partkey AS t_part, l_extendedprice AS t_price, l_shipdate AS t_ship, printf('%.2f', l_discount) || '|' || printf('%.2f', l_tax) || '|' || l_linestatus AS t_rest,
    regexp_replace(lower(replace(p_name, '*', 'x')), '\\s+', '', 'g') || '|' || regexp_replace(lower(replace(p_type || ' ' || p_size, '*', 'x')), '\\s+', '', 'g') AS item_key
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)"""
SQL_ORDER = "is_supplement, source_file, line_no, t_part, t_price, quantity, t_ship, t_rest"
SQL_ORDER_DESC = ", ".join(f"{c} DESC" for c in SQL_ORDER.split(", "))
SQL_MERGED = f"""{SQL_LINES}, merged AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY supplier_name, item_key ORDER BY {SQL_ORDER_DESC}) AS rn FROM lines) WHERE rn = 1
)"""
SQL_STATS = f"""{SQL_MERGED}, stats AS (
  SELECT item_key, count(*) AS n_entries, count(unit_price) AS n_priced, min(unit_price) AS min_price, max(unit_price) AS max_price, avg(unit_price) AS avg_price,
    count(lead_time_days) AS n_leads, min(lead_time_days) AS min_lead_days, max(lead_time_days) AS max_lead_days, median(lead_time_days) AS median_lead_days
  FROM merged GROUP BY item_key
)"""
SQL_CELLS = f"""{SQL_STATS}, cells AS (
  SELECT m.item_key, m.supplier_name, m.unit_price, m.quantity, m.lead_time_days, m.confidence, (m.unit_price - s.avg_price) / nullif(s.avg_price, 0) AS deviation,
    CASE WHEN m.confidence = 'low' OR m.flagged THEN 'FFF3CD' WHEN s.n_priced >= 2 AND m.unit_price = s.min_price THEN 'C6EFCE'
         WHEN s.n_priced >= 2 AND (m.unit_price - s.avg_price) / nullif(s.avg_price, 0) > 0.15 THEN 'FFC7CE' END AS price_color,
    CASE WHEN m.confidence = 'low' OR m.flagged THEN 'FFF3CD' WHEN s.n_leads >= 2 AND m.lead_time_days = s.max_lead_days AND s.max_lead_days > 2 * s.median_lead_days THEN 'FFE0B2' END AS lead_color
  FROM merged m JOIN stats s USING (item_key)
), gray AS (
  SELECT s.item_key, u.supplier_name FROM stats s CROSS JOIN (SELECT DISTINCT supplier_name FROM merged) u
  WHERE s.n_entries > 1 AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.item_key = s.item_key AND m.supplier_name = u.supplier_name)
)"""
SQL_RAW = """raw AS (
  SELECT 'order-' || l_orderkey || CASE WHEN l_returnflag = 'R' THEN '-补充' ELSE '' END AS source_file, l_linenumber AS line_no,
    CASE WHEN l_tax = 0 THEN ' ' ELSE 'item ' || l_partkey END AS item_name, CAST(l_quantity AS INTEGER) AS q, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS up, CAST(floor(l_extendedprice) AS BIGINT) AS am,
    CASE WHEN l_linestatus = 'O' THEN ' PCS' WHEN l_returnflag = 'A' THEN 'Sets' ELSE '托' END AS unit, CASE l_returnflag WHEN 'A' THEN '含税' WHEN 'R' THEN '不含税' ELSE '' END AS remark, l_returnflag,
    CASE l_linenumber WHEN 1 THEN '¥' || up WHEN 2 THEN up || '块5' WHEN 3 THEN '$' || up WHEN 4 THEN up || '元（含税13%）' WHEN 5 THEN 'l' || up || '元' WHEN 6 THEN '面议' ELSE '' END AS unit_price_raw,
    CASE WHEN l_returnflag = 'N' THEN '' ELSE am || '元' END AS amount_raw,
    CASE l_linenumber WHEN 1 THEN q || '天' WHEN 2 THEN q || '-' || (q + 3) || '天' WHEN 3 THEN '现货' WHEN 4 THEN q || '周' WHEN 5 THEN '十二天' WHEN 6 THEN '半个月' ELSE '尽快' END AS lead_time_raw
  FROM lineitem
), parsed AS (
  SELECT *, CAST(q AS DOUBLE) AS quantity, CASE WHEN unit_price_raw ~ '.*[0-9]+块[0-9].*' THEN CAST(up || '.5' AS DOUBLE) WHEN regexp_matches(unit_price_raw, '[0-9]') THEN CAST(up AS DOUBLE) END AS unit_price,
    CASE WHEN amount_raw <> '' THEN CAST(am AS DOUBLE) END AS amount,
    CASE line_no WHEN 1 THEN q WHEN 2 THEN q + 3 WHEN 3 THEN 0 WHEN 4 THEN q * 7 WHEN 5 THEN 12 WHEN 6 THEN 15 END AS days FROM raw
)"""
