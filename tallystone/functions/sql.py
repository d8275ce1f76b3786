"""The text functions under names, for SQL.

A function is a temporary SQL function whose body is the expression of the column function, so that calls are
made in the JVM and optimised with the query around them. Chunks are a table function.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..operators.extraction import pack_lines
from . import text as T

#: Names, their arguments (all texts), and the columns that they stand for.
FUNCTIONS = {
    "parse_number": (("x",), T.parse_number),
    "parse_lead_time": (("x",), T.parse_lead_time),
    "detect_currency": (("x",), T.detect_currency),
    "detect_tax": (("x",), T.detect_tax),
    "ocr_confusion": (("x",), T.ocr_confusion),
    "chinese_int": (("x",), T.chinese_int),
    "normalize_item": (("x",), T.normalize_text),
    "item_key": (("name", "spec"), T.item_key),
    "display_text": (("name", "spec"), T.display_text),
    "provenance_text": (("x",), T.provenance),
    "safe_name": (("x",), T.safe_name),
    "is_supplement": (("x",), T.is_supplement),
}


class Chunks:
    """chunk_lines(text, limit): a text's chunks of whole lines, from 0 on; none for null."""

    def eval(self, text: str, limit: int) -> Iterator[tuple[int, int, str]]:
        parts = pack_lines(text, limit) if text is not None else []
        for n, part in enumerate(parts):
            yield n, len(parts), part


def body(spark: SparkSession, arguments: tuple[str, ...], of: Column) -> tuple[str, DataType]:
    """A column over the arguments as SQL, and its type."""
    rows = spark.createDataFrame([], ", ".join(f"{a} string" for a in arguments)).select(of.alias("out"))
    made = rows._jdf.queryExecution().analyzed().projectList().head()
    return made.child().sql(), rows.schema["out"].dataType


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to spark.sql() for this session; their names."""
    for name, (arguments, f) in FUNCTIONS.items():
        text, kind = body(spark, arguments, f(*map(F.col, arguments)))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} STRING' for a in arguments)}) RETURNS {kind.simpleString()} RETURN {text}")
    spark.udtf.register("chunk_lines", F.udtf(Chunks, returnType="chunk_no int, n_chunks int, chunk string"))
    return [*FUNCTIONS, "chunk_lines"]
