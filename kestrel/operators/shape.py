"""Result-shape hints and agent-trace shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.text import DATE_LIKE, strip

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
BAR_MAX_ROWS = 20
LINE_MIN_ROWS = 3


def chart_hint(df: DataFrame) -> DataFrame:
    """'line' | 'bar' | 'none' for a query result (first two columns).

    At least 2 rows and 2 columns with a numeric second column; 'line' when
    there are >= 3 rows and every first-column value is a date or date-like
    text (YYYY, YYYY-MM, YYYY-MM-DD); 'bar' when there are <= 20 rows of text
    labels. One aggregate pass over the whole result (capping belongs to the
    query surface)."""
    fields = df.schema.fields
    if len(fields) < 2 or not isinstance(fields[1].dataType, NUMERIC):
        return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit("none").alias("chart"))
    x = F.col(f"`{fields[0].name}`")
    t0 = fields[0].dataType
    if isinstance(t0, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        datelike = x.isNotNull()
    elif isinstance(t0, T.StringType):
        datelike = F.coalesce(strip(x).rlike(DATE_LIKE), F.lit(False))
    else:
        datelike = F.lit(False)
    is_text = x.isNotNull() if isinstance(t0, T.StringType) else F.lit(False)
    y_num = F.col(f"`{fields[1].name}`").isNotNull()
    a = df.agg(F.count(F.lit(1)).alias("rows"), F.bool_and(datelike).alias("_dates"),
                   F.bool_and(is_text).alias("_text"), F.bool_and(y_num).alias("_num"))
    chart = (F.when((F.col("rows") < 2) | ~F.col("_num"), F.lit("none"))
              .when((F.col("rows") >= LINE_MIN_ROWS) & F.col("_dates"), F.lit("line"))
              .when((F.col("rows") <= BAR_MAX_ROWS) & F.col("_text"), F.lit("bar"))
              .otherwise(F.lit("none")))
    return a.select("rows", chart.alias("chart"))


STEP = "struct<tool:string,tool_input:string,observation:string>"
# A Python literal inside a row; in the text of an observation each is replaced by one letter.
_ATOM = (r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'|\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\""
         r"|[-+]?(?:\d++\.?\d*+|\.\d++)(?:[eE][-+]?\d++)?|\b(?:None|True|False)\b")
_ROW = r"(?:\(\s*+v(?:\s*+,\s*+v)*+\s*+,?\s*+\)|\[\s*+v(?:\s*+,\s*+v)*+\s*+,?\s*+\])"
_ROW_LIST = rf"^\s*+\[\s*+{_ROW}(?:\s*+,\s*+{_ROW})*+\s*+,?\s*+\]\s*+$"


def is_row_list(text: Column) -> Column:
    """Whether a text is a list of rows (tuples or lists of literals), all of one width, of two columns or more."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?<![\w'\"])v|v(?![\w'\"])", "?"), _ATOM, "v")
    inner = F.regexp_replace(bare, r"^\s*+\[|\]\s*+$", "")
    widths = F.transform(F.regexp_extract_all(inner, F.lit(f"({_ROW})"), 1),
                         lambda r: F.length(F.regexp_replace(r, "[^v]", "")))
    return F.coalesce(bare.rlike(_ROW_LIST) & (F.array_min(widths) == F.array_max(widths)) & (F.array_min(widths) > 1),
                      F.lit(False))


def shape_trace(df: DataFrame, steps_col: str = "steps", input_chars: int = 500,
                observation_chars: int = 1000) -> DataFrame:
    """Truncate every step's input to 500 and observation to 1,000 characters."""
    return df.withColumn(steps_col, F.transform(F.col(steps_col), lambda s: F.struct(
        s["tool"].alias("tool"),
        F.substring(s["tool_input"], 1, input_chars).alias("tool_input"),
        F.substring(s["observation"], 1, observation_chars).alias("observation"))))


def last_sql_step(df: DataFrame, steps_col: str = "steps") -> DataFrame:
    """The latest step whose tool name mentions sql/query and whose observation is a row list.

    Adds ``sql_text`` and ``sql_rows`` (the observation) per trace row; NULL if none."""
    indexed = F.transform(F.col(steps_col), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    ok = F.filter(indexed, lambda e: (F.lower(e["s"]["tool"]).contains("sql") | F.lower(e["s"]["tool"]).contains("query"))
                  & is_row_list(e["s"]["observation"]))
    last = F.element_at(ok, -1)
    return df.withColumn("_last", F.when(F.size(ok) > 0, last)) \
             .withColumn("sql_text", F.col("_last")["s"]["tool_input"]) \
             .withColumn("sql_rows", F.col("_last")["s"]["observation"]).drop("_last")
