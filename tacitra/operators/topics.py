"""Topics without an embedding model at hand: words of a class, categories by keywords, nearest centroids."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tacitra.operators.expertise import top_k

if TYPE_CHECKING:
    from pyspark.ml import PipelineModel


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)


def class_words(docs: DataFrame, label: str, text: str, k: int = 8) -> DataFrame:
    """(label, rk, word, tfidf): the ``k`` words of a class by term frequency times log(1 + average class size / corpus frequency)."""
    tokens = docs.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(words(F.col(text))).alias("word")).groupBy("label", "word").agg(F.count(F.lit(1)).alias("tf"))
    corpus = tokens.groupBy("word").agg(F.sum("tf").alias("f"))
    size = tokens.agg((F.sum("tf") / F.countDistinct("label")).alias("a"))
    totals = tokens.groupBy("label").agg(F.sum("tf").alias("n"))
    score = tokens.join(corpus, "word").join(totals, "label").crossJoin(F.broadcast(size)).withColumn("tfidf", F.col("tf") / F.col("n") * F.log(1 + F.col("a") / F.col("f")))
    return top_k(score, ["label"], [F.desc(F.round("tfidf", 9)), F.asc("word")], k).select("label", "rk", "word", "tfidf")


def categorise(topic_words: DataFrame, keywords: DataFrame, fallback: str, first: int = 8) -> DataFrame:
    """(topic, category): sum of the keyword weights of the distinct first words; the first category wins ties.

    ``topic_words`` (topic, words array), ``keywords`` (cat_ord, category, word, weight).
    """
    exploded = topic_words.select("topic", F.explode(F.array_distinct(F.transform(F.slice("words", 1, first), F.lower))).alias("word"))
    scored = exploded.join(keywords, "word").groupBy("topic", "cat_ord", "category").agg(F.sum("weight").alias("s"))
    best = scored.groupBy("topic").agg(F.min_by("category", F.struct(-F.col("s"), F.col("cat_ord"))).alias("category"))
    return topic_words.select("topic").join(best, "topic", "left").select("topic", F.coalesce("category", F.lit(fallback)).alias("category"))


def centroids(vectors: DataFrame, label: str, vector: str, size: int) -> DataFrame:
    """(label, centroid): component-wise means."""
    means = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(size)]
    return vectors.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.array(*means).alias("centroid"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(_dot(a, b), F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))), F.lit(0.0))


def assign(vectors: DataFrame, id_col: str, vector: str, centres: DataFrame, block: int = 10_000) -> DataFrame:
    """(id, label, similarity) of the nearest centroid by cosine; ties (to nine places) go to the smaller label.

    The centroids come in blocks of ``block`` at most, each one matrix that is broadcast and multiplied with Arrow batches
    of vectors; more centroids mean more passes, of which the best is kept per id. A null or empty vector, or one of
    norm 0, has similarity 0 to all; a repeated id gives one row.
    """
    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    kinds = source.schema["id"].dataType, centres.schema["label"].dataType
    schema = f"id {kinds[0].simpleString()}, label {kinds[1].simpleString()}, similarity double"

    def against(rows: list) -> DataFrame:
        labels, matrix = [r.label for r in rows], np.array([r.centroid for r in rows], float)
        norms = np.linalg.norm(matrix, axis=1)
        matrix = np.divide(matrix, norms[:, None], out=np.zeros_like(matrix), where=norms[:, None] > 0)
        shared = source.sparkSession.sparkContext.broadcast((labels, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, known = shared.value
            size = known.shape[1]
            for batch in batches:
                if not batch.num_rows:
                    continue
                given = [[0.0 if x is None else x for x in v] if v is not None and len(v) == size else [0.0] * size for v in batch.column(1).to_pylist()]
                each = np.array(given, float).reshape(-1, size)
                length = np.linalg.norm(each, axis=1)
                close = np.divide(each, length[:, None], out=np.zeros_like(each), where=length[:, None] > 0) @ known.T
                best = np.argmax(np.round(close, 9), axis=1)  # labels are in order, so the first of equals is the smallest
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in best], to_arrow_type(kinds[1])), pa.array(close[np.arange(len(best)), best])], names=["id", "label", "similarity"])

        return source.mapInArrow(run, schema)

    parts, rows = [], []
    for row in centres.where("centroid IS NOT NULL").orderBy("label").toLocalIterator():
        rows.append(row)
        if len(rows) == block:
            parts, rows = [*parts, against(rows)], []
    if rows:
        parts.append(against(rows))
    if not parts:
        return source.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    best = whole.groupBy("id").agg(F.min_by(F.struct("label", "similarity"), F.struct(-F.round("similarity", 9), F.col("label"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "b.label", "b.similarity")


def fit_clusters(vectors: DataFrame, vector: str, k: int, seed: int = 42, most_rows: int = 50_000) -> PipelineModel:
    """A k-means model of at most ``most_rows`` vectors (those with the smallest hashes), as a pipeline that can be saved and loaded."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans

    sample = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(vector)), F.col(vector)).limit(most_rows)
    return Pipeline(stages=[KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label")]).fit(_features(sample, vector))


def with_clusters(vectors: DataFrame, vector: str, model: PipelineModel, least: int = 30) -> DataFrame:
    """Every vector with its cluster; clusters of fewer than ``least`` members are outliers (-1)."""
    return without_small(model.transform(_features(vectors.where(F.col(vector).isNotNull()), vector)).drop("features"), least)


def _features(vectors: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors.withColumn("features", array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))))


def without_small(assigned: DataFrame, least: int = 30, outlier: int = -1) -> DataFrame:
    """Classes of fewer than ``least`` members become outliers."""
    sizes = assigned.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return assigned.join(sizes, "label").withColumn("label", F.when(F.col("n") < least, F.lit(outlier)).otherwise(F.col("label"))).drop("n")


def hashed_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows: those with the smallest hashes of id and seed."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(n)
