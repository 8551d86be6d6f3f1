"""Uploaded files and their previews: CSV, JSON rows, gazetteers, plans, column mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotspark.operators.cleaning import RAW_COLUMNS
from depotspark.operators.geometry import PLAN
from depotspark.sources.xlsx import read_workbook


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; gzip by its ending."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """{"headers": [...], "rows": [[...], ...]}."""
    whole = spark.read.schema("headers array<string>, rows array<array<string>>").option("multiLine", True).json(path)
    names = whole.select("headers").first()[0]
    rows = whole.select(F.explode("rows").alias("r"))
    return rows.select(*[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By extension: csv (also gzipped), json, parquet, and workbooks; the older binary workbooks are refused."""
    kind = path.lower().removesuffix(".gz").rpartition(".")[2]
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "json":
        return read_json_rows(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("xlsx", "xlsm"):
        return read_workbook(spark, path)
    if kind == "xls":
        raise ValueError("binary workbooks (.xls) can't be read; save as .xlsx or .csv")
    raise ValueError(f"no reader for .{kind}")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame | None:
    """CSV with lower-cased headers; None where it can't be read."""
    try:
        df = spark.read.option("header", True).csv(path)
    except Exception as e:  # a missing file is a gazetteer that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_zones(spark: SparkSession, path: str, means: DataFrame | None = None) -> DataFrame:
    """Zones as a JSON list; distances by the plan's means (zone_id, d), rounded to 2, where there are any."""
    z = spark.read.schema("id string, name string, section string, material string, area_m2 double, distance_m double").option("multiLine", True).json(path).withColumnRenamed("id", "zone_id")
    if means is None:
        return z
    return z.join(F.broadcast(means), "zone_id", "left").withColumn("distance_m", F.coalesce(F.round("d", 2), "distance_m")).drop("d")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """One row: a floor plan (see geometry.PLAN), bare JSON or assigned to a JavaScript constant."""
    text = spark.read.option("wholetext", True).text(path).select(F.regexp_extract("value", r"(?s)\{.*\}", 0).alias("t"))
    return text.select(F.from_json("t", PLAN).alias("p")).select("p.*")


def suggested_mapping(columns: list[str]) -> dict[str, str | None]:
    """For each required column the file's column of the same trimmed name, None where the user has to choose."""
    trimmed = {c.strip(): c for c in reversed(columns)}
    return {c: trimmed.get(c) for c in RAW_COLUMNS}


def preview(df: DataFrame, n: int = 20) -> dict:
    """What a user sees of a file before mapping it: trimmed columns, number of rows, missing required columns, suggested mapping, first rows."""
    mapping = suggested_mapping(df.columns)
    return {"columns": [c.strip() for c in df.columns], "row_count": df.count(), "missing": [c for c, v in mapping.items() if v is None], "mapping": mapping, "rows": df.limit(n)}


def page(df: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    return df.orderBy(order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """mapping: required name -> column of the file. A column of a required name that isn't its source is dropped first."""
    unknown = [k for k in mapping if k not in RAW_COLUMNS]
    absent = [v for v in mapping.values() if v not in df.columns]
    if unknown or absent or len(set(mapping.values())) < len(mapping):
        raise ValueError(f"unknown targets {unknown}, missing sources {absent}, or a source used twice")
    df = df.drop(*[k for k, v in mapping.items() if k != v and k in df.columns and k not in mapping.values()])
    return df.withColumnsRenamed({v: k for k, v in mapping.items()})
