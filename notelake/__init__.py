"""Fleet-note analytics and corpus preparation on PySpark.

functions/  column builders (text, scores, labels)
operators/  DataFrame -> DataFrame operators
plans/      the registered queries, each with its DuckDB twin
sources/    adapters over Parquet tables, scratch space, sinks
streaming/  Structured Streaming forms, each with a batch twin
llm/        training-corpus operators; nothing else imports it
"""
