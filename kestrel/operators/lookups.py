"""Dimension and rate lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions import metrics as M
from kestrel.functions.text import strip
from kestrel.operators.scalars import with_scalars

# Brazilian states (code, name, capital), the bundled dimension.
BR_STATES = (
    ("AC", "Acre", "Rio Branco"),
    ("AL", "Alagoas", "Maceió"),
    ("AP", "Amapá", "Macapá"),
    ("AM", "Amazonas", "Manaus"),
    ("BA", "Bahia", "Salvador"),
    ("CE", "Ceará", "Fortaleza"),
    ("DF", "Distrito Federal", "Brasília"),
    ("ES", "Espírito Santo", "Vitória"),
    ("GO", "Goiás", "Goiânia"),
    ("MA", "Maranhão", "São Luís"),
    ("MT", "Mato Grosso", "Cuiabá"),
    ("MS", "Mato Grosso do Sul", "Campo Grande"),
    ("MG", "Minas Gerais", "Belo Horizonte"),
    ("PA", "Pará", "Belém"),
    ("PB", "Paraíba", "João Pessoa"),
    ("PR", "Paraná", "Curitiba"),
    ("PE", "Pernambuco", "Recife"),
    ("PI", "Piauí", "Teresina"),
    ("RJ", "Rio de Janeiro", "Rio de Janeiro"),
    ("RN", "Rio Grande do Norte", "Natal"),
    ("RS", "Rio Grande do Sul", "Porto Alegre"),
    ("RO", "Rondônia", "Porto Velho"),
    ("RR", "Roraima", "Boa Vista"),
    ("SC", "Santa Catarina", "Florianópolis"),
    ("SP", "São Paulo", "São Paulo"),
    ("SE", "Sergipe", "Aracaju"),
    ("TO", "Tocantins", "Palmas"),
)
# Fixed value: BRL->USD rate used when no rate is known.
FALLBACK_RATE = 0.20

STATE_SCHEMA = T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType()),
                             T.StructField("capital", T.StringType())])
RATE_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("from_ccy", T.StringType()),
                            T.StructField("to_ccy", T.StringType()), T.StructField("rate", T.DoubleType())])


def state_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BR_STATES), STATE_SCHEMA)


def normalize_state_code(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(F.upper(strip(c)), 1, 2)


def lookup_states(df: DataFrame, code_col: str, out: str = "state_info") -> DataFrame:
    """``SP = São Paulo (capital: São Paulo)``, or ``No Brazilian state found for code 'ZZ'.``

    The dimension is 27 literal rows, so broadcasting it is bounded by
    construction; the input table is never shuffled."""
    dim = state_dimension(df.sparkSession)
    keyed = df.withColumn("_code", normalize_state_code(code_col))
    j = keyed.join(F.broadcast(dim), keyed["_code"] == dim["code"], "left")
    found = F.concat(F.col("_code"), F.lit(" = "), F.col("name"), F.lit(" (capital: "), F.col("capital"), F.lit(")"))
    missing = F.concat(F.lit("No Brazilian state found for code '"), F.col("_code"), F.lit("'."))
    return j.select(*[keyed[c] for c in df.columns], F.coalesce(found, missing).alias(out))


def sql_functions(rate: float) -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, result type, body) of the SQL functions: state text, rate conversion and business terms.

    A null code has the text of no state, null amounts give null, and what has a null time is not late."""
    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    states = ", ".join(f"{text(code)}, {text(f'{code} = {name} (capital: {capital})')}" for code, name, capital in BR_STATES)
    code = "substring(upper(trim(BOTH ' \\t\\n\\r' FROM coalesce(code, ''))), 1, 2)"
    missing = f"concat('No Brazilian state found for code \\'', {code}, '\\'.')"
    return {
        "state_info": ("code STRING", "STRING", f"coalesce(try_element_at(map({states}), {code}), {missing})"),
        "to_usd": ("amount DECIMAL(38,2)", "DECIMAL(38,2)", f"CAST(round(amount * CAST({rate!r} AS DECIMAL(10,4)), 2) AS DECIMAL(38,2))"),
        "item_revenue": ("price DECIMAL(38,2), freight DECIMAL(38,2)", "DECIMAL(38,2)", "CAST(price + freight AS DECIMAL(38,2))"),
        "delivered_late": ("delivered TIMESTAMP_NTZ, estimated TIMESTAMP_NTZ", "BOOLEAN", M.is_late_sql("delivered", "estimated")),
    }


def latest_rate(rates: DataFrame, from_ccy: str = "BRL", to_ccy: str = "USD") -> DataFrame:
    """One row: the last known rate (max_by date) or the flagged fallback."""
    r = rates.filter((F.col("from_ccy") == from_ccy) & (F.col("to_ccy") == to_ccy))
    a = r.agg(F.max_by("rate", "date").alias("_r"), F.max("date").alias("rate_date"))
    return a.select(F.coalesce(F.col("_r"), F.lit(FALLBACK_RATE)).alias("rate"),
                    F.col("_r").isNull().alias("is_fallback"),
                    F.coalesce(F.col("rate_date").cast("string"), F.lit("fallback")).alias("rate_date"))


def with_latest_rate(df: DataFrame, rates: DataFrame, **kw) -> DataFrame:
    """Attach the single latest rate (a one-row aggregate) to every row."""
    return with_scalars(df, latest_rate(rates, **kw))


def as_of_rate(df: DataFrame, date_col: str, rates: DataFrame, from_ccy: str = "BRL", to_ccy: str = "USD") -> DataFrame:
    """``df`` with the last rate dated on or before each row's date (fallback, flagged, before the first quote).

    The distinct days of ``df`` (combined map-side, so at most one row per
    calendar day) are put in order with the quotes, each day takes the last
    quote so far, and the rows join their day: an equi-join, whatever range
    of dates the data has. A null date has no rate known, so the fallback."""
    quotes = rates.filter((F.col("from_ccy") == from_ccy) & (F.col("to_ccy") == to_ccy)).groupBy("date").agg(
        F.max("rate").alias("_quote"))
    day = F.to_date(F.col(date_col))
    days = df.select(day.alias("_day")).distinct().unionByName(quotes.select(F.col("date").alias("_day"))).distinct()
    known = days.join(quotes.withColumnRenamed("date", "_day"), "_day", "left").select(
        "_day", F.last("_quote", ignorenulls=True).over(
            Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)).alias("_known"))
    keyed = df.withColumn("_on", day)
    return keyed.join(known, keyed["_on"].eqNullSafe(known["_day"]), "left").withColumns({
        "rate": F.coalesce("_known", F.lit(FALLBACK_RATE)), "is_fallback": F.col("_known").isNull()}).drop(
        "_on", "_day", "_known")
