"""Sources and sinks beside parquet: delimited mail dumps, JSON documents, GraphML, saved models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_mail_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, message) of a quoted CSV with line breaks inside fields; bad bytes are replaced, bad rows kept."""
    return spark.read.csv(path, schema="file string, message string", header=True, multiLine=True, escape='"', mode="PERMISSIVE", maxCharsPerColumn=-1, encoding="UTF-8")


def read_json_map(spark: SparkSession, path: str, value: str = "array<string>") -> DataFrame:
    """(key, value) of a JSON file that holds one object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty one of ``schema`` where nothing is there."""
    try:
        return spark.read.format(form).schema(schema).load(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of a GraphML file; a missing or unreadable weight is 1."""
    rows = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, data string").load(path)
    return rows.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce(F.expr("try_cast(data as double)"), F.lit(1.0)).alias("weight"))


def write_graphml(edges: DataFrame, path: str) -> None:
    """Edges as GraphML elements, one file per partition."""
    rows = edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), F.col("weight").alias("data"))
    rows.write.mode("overwrite").format("xml").option("rowTag", "edge").option("rootTag", "graphml").save(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def update_field(spark: SparkSession, source: str, target: str, key: str, changes: DataFrame, field: str) -> None:
    """``source`` rewritten to ``target`` with the values of ``changes`` (key, field); other rows keep theirs."""
    old = spark.read.json(source)
    new = old.join(changes.select(key, F.col(field).alias("_new")), key, "left")
    new.withColumn(field, F.coalesce("_new", field)).drop("_new").write.mode("overwrite").json(target)
