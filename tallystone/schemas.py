"""Schemas of the engine's tables."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

S, D, I, B = StringType(), DoubleType(), IntegerType(), BooleanType()


def _struct(*fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


FILES = _struct(("file", S), ("source_file", S), ("kind", S), ("detail", S))
RAW = _struct(("source_file", S), ("kind", S), ("raw_text", S), ("extraction_warnings", ArrayType(S)), ("low_ocr_lines", ArrayType(S)))
QUOTES = _struct(("source_file", S), ("kind", S), ("supplier_name", S), ("warnings", ArrayType(S)))
#: What a model returns for one line: texts as they stand in the source, nothing computed.
PAYLOAD_LINE = _struct(
    ("item_name", S), ("spec", S), ("quantity_raw", S), ("unit", S), ("unit_price_raw", S), ("amount_raw", S), ("currency", S), ("tax_included", B),
    ("lead_time_raw", S), ("payment_terms", S), ("remark", S), ("confidence", S), ("source_snippet", S),
)
PAYLOAD = _struct(("supplier_name", S), ("lines", ArrayType(PAYLOAD_LINE)))
MATCH_RESULT = _struct(("id", S), ("same", B), ("confidence", S), ("reason", S))
MATCH_PAYLOAD = _struct(("results", ArrayType(MATCH_RESULT)))
QUOTE_LINES = StructType(
    [StructField("source_file", S), StructField("line_no", I), StructField("supplier_name", S), *PAYLOAD_LINE.fields[:3], StructField("quantity", D), *PAYLOAD_LINE.fields[3:5], StructField("unit_price", D)]
    + [*PAYLOAD_LINE.fields[5:9], StructField("lead_time_days", I), *PAYLOAD_LINE.fields[9:], StructField("flags", ArrayType(S))]
)
FINDING = _struct(("rule_ord", I), ("part", I), ("rule", S), ("message", S))
