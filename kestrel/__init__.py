"""kestrel: marketplace analytics as Spark DataFrame jobs.

Layout:
  sources/    table readers, the commerce model over the driver tables, raw CSV schemas, sinks
  functions/  Column expressions (text, time, money, JSON) and the business formulas
  operators/  reusable table operators (dedupe, top-k, imputation, integrity, logs, guard, eval)
  plans/      marts, KPIs, business questions, ETL, and the named-query registry
  streaming/  Structured Streaming twins of the log operators
"""

__version__ = "0.1.0"
