"""Writers of results and of dataset manifests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The given columns, in this order, with a header; missing columns are written as null."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_missing(cache_path: str, wanted: DataFrame, keys: list[str], compute) -> DataFrame:
    """Append-only cache: rows of ``wanted`` whose key is not in the table at ``cache_path`` go through ``compute`` and are
    appended; the table is returned. A table that is not there yet counts as empty."""
    spark = wanted.sparkSession
    try:
        known = spark.read.parquet(cache_path)
        todo = wanted.join(known.select(*keys).distinct(), keys, "left_anti")
    except Exception:  # no table yet
        todo = wanted
    compute(todo).write.mode("append").parquet(cache_path)
    return spark.read.parquet(cache_path)


def safe_name(name: str) -> str:
    """Letters, digits, points, dashes and underscores; anything else becomes one dash."""
    return re.sub(r"[^A-Za-z0-9._-]+", "-", name).strip("-") or "dataset"


def write_manifest(df: DataFrame, folder: str, name: str, inserted: int, skipped: int, errors: list[str], warnings: list[str]) -> None:
    """One JSON manifest of a dataset: counts, share of filled rows per field, messages and time."""
    fields = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in df.columns]).select("rows", F.to_json(F.struct(*df.columns)).alias("filled"))
    out = fields.select(F.lit(name).alias("name"), "rows", F.from_json("filled", "map<string, bigint>").alias("filled"), F.lit(inserted).alias("inserted"), F.lit(skipped).alias("skipped"), F.array(*[F.lit(e) for e in errors]).cast("array<string>").alias("errors"), F.array(*[F.lit(w) for w in warnings]).cast("array<string>").alias("warnings"), F.current_timestamp().alias("written_at"))
    out.coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/{safe_name(name)}.manifest")


def latest_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The row of the manifest written last; no rows if there is none."""
    schema = "name string, rows bigint, filled map<string, bigint>, inserted bigint, skipped bigint, errors array<string>, warnings array<string>, written_at timestamp"
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(folder).orderBy(F.desc("written_at"), "name").limit(1)


def write_report(spark: SparkSession, folder: str, name: str, facts: dict, tables: dict[str, DataFrame], most: int = 200) -> None:
    """A report as <name>.json and <name>.md: facts, and tables of aggregated rows, each of no more than ``most`` rows; a larger
    table is an error, since a report is for reading."""
    import json

    held = {}
    for title, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"table {title} has more than {most} rows")
        held[title] = (df.columns, [[None if v is None else v for v in r] for r in rows])
    whole = {"facts": facts, "tables": {t: [dict(zip(c, r)) for r in rows] for t, (c, rows) in held.items()}}
    lines = [f"# {name}", "", *[f"- {k}: {v}" for k, v in facts.items()]]
    for title, (columns, rows) in held.items():
        lines += ["", f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]]
    for end, text in (("json", json.dumps(whole, default=str, ensure_ascii=False)), ("md", "\n".join(lines))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{folder.rstrip('/')}/{safe_name(name)}.{end}")
