"""Text and vector features for clustering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as tx
from ..session import stored
from . import postings

TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"


def terms(text: Column) -> Column:
    """Lower-cased words of at least two characters, numbers as one placeholder."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))
    return F.transform(found, tx.normalize_number)


def tfidf(docs: DataFrame, key: str, text: str, only: DataFrame | None = None, words: int = postings.BLOCK) -> DataFrame:
    """``key, term, weight``: raw counts times ``ln((1+n)/(1+df)) + 1``, each
    document scaled to unit length; with ``only``, of the documents whose key is
    there (frequencies are those of all documents all the same).

    Counts are made once and written as postings of blocks of ``words`` words. A term
    meets its frequency once per block, and no row per document and term travels;
    rows that share a key, which lie anywhere, meet as such rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("shared")), "shared-keys")
    same = F.col("key").eqNullSafe(F.col("shared"))
    some = not shared.isEmpty()
    alone = rows.join(shared, same, "left_anti") if some else rows
    posts = stored(postings.posted(alone.select("key", terms(F.col("text")).alias("terms")), words), "postings")
    in_blocks = postings.in_blocks(posts)
    frequencies = in_blocks.select("term", "n")
    if some:
        counts = stored(
            rows.join(shared, same, "left_semi")
            .select("key", F.explode(terms(F.col("text"))).alias("term"))
            .groupBy("key", "term")
            .agg(F.count("*").alias("tf")),
            "term-counts",
        )
        frequencies = frequencies.unionAll(counts.select("term", F.lit(1).cast("bigint").alias("n")))
    n_docs = rows.agg(F.count("*")).scalar()
    idf = (
        frequencies.groupBy("term")
        .agg(F.sum("n").alias("df"))
        .select("term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("weight"))
    )
    given = in_blocks.join(idf.hint("shuffle_hash"), "term").select("block", "no", "weight")
    if only is not None:
        asked = only.select(F.col(key).alias("key")).distinct()
        places = postings.keys_in_blocks(posts).join(asked, "key", "left_semi")
        given = given.unionAll(places.select("block", "no", F.lit(None).cast("double")))
    out = postings.scaled(posts, given, key, only is not None)
    if not some:
        return out
    wanted = counts if only is None else counts.join(asked, "key", "left_semi")
    raw = wanted.join(idf.hint("shuffle_hash"), "term").select("key", "term", (F.col("tf") * F.col("weight")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return out.unionAll(raw.select("key", "term", (F.col("w") / norm).alias("weight")))


def top_terms(weights: DataFrame, clusters: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Per cluster its ``k`` heaviest centroid terms, pivoted to ``term_0..``.

    Centroid weights are sums over the cluster divided by its size; the ranking
    window keeps only ``k`` rows per task and cluster before it shuffles.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    centroid = (
        weights.join(clusters.select(key, "cluster"), key)
        .groupBy("cluster", "term")
        .agg(F.sum("weight").alias("total"))
        .join(sizes, "cluster")
        .select("cluster", "term", F.round(F.col("total") / F.col("n"), 9).alias("score"))
    )
    w = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "term")
    ranked = centroid.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    names = [f"term_{i}" for i in range(k)]
    labelled = ranked.select("cluster", F.concat(F.lit("term_"), (F.col("rank") - 1).cast("string")).alias("slot"), "term")
    return labelled.groupBy("cluster").pivot("slot", names).agg(F.first("term"))


def fit_svd(vectors: DataFrame, column: str, k: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Truncated SVD without centring: ``(singular values, d x k matrix)``.

    Each task adds up the d x d Gram matrix of its rows; the sum, whose size is
    set by the embedding width alone, is decomposed on the driver.
    """

    def gram(batches):
        total = None
        for pdf in batches:
            m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel()]})

    cells = (
        vectors.select(F.col(column).cast("array<double>").alias("v"))
        .mapInPandas(gram, "g array<double>")
        .select(F.posexplode("g").alias("i", "x"))
        .groupBy("i")
        .agg(F.sum("x").alias("x"))
        .orderBy("i")
        .toPandas()
    )
    d = math.isqrt(len(cells))
    values, basis = np.linalg.eigh(cells["x"].to_numpy().reshape(d, d))
    order = values.argsort()[::-1][: min(k, d)]
    return np.sqrt(np.clip(values[order], 0, None)), basis[:, order]


def project(vectors: DataFrame, column: str, matrix: np.ndarray, out: str = "reduced", normalize: bool = False) -> DataFrame:
    """Rows times a small ``d x k`` matrix (a dense product per Arrow batch),
    optionally scaled to unit length."""
    basis = np.ascontiguousarray(matrix)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(v: pd.Series) -> pd.Series:
        rows = np.stack(v.to_numpy()).astype(np.float64) @ basis
        if normalize:
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
        return pd.Series(list(rows))

    return vectors.withColumn(out, apply(F.col(column)))


def unit_length(df: DataFrame, column: str, out: str) -> DataFrame:
    ready = df.withColumn("_v", array_to_vector(F.col(column)))
    return (
        Normalizer(inputCol="_v", outputCol="_u", p=2.0)
        .transform(ready)
        .withColumn(out, vector_to_array("_u"))
        .drop("_v", "_u")
    )


def reduce_vectors(vectors: DataFrame, column: str, k: int = 100, svd: bool = True, norm: bool = True) -> DataFrame:
    """Adds ``reduced``; without ``svd`` the vectors as they are."""
    if not svd:
        return vectors.withColumn("reduced", F.col(column).cast("array<double>"))
    _, v = fit_svd(vectors, column, k)
    return project(vectors, column, v, "reduced", norm)



class VectorReducer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted reduction as a pipeline stage: rows times a ``width x k`` matrix,
    optionally scaled to unit length. ``save`` and ``load`` keep the matrix (whose
    size is set by the vectors' width and ``k``, not by rows) with the parameters."""

    matrix = Param(Params._dummy(), "matrix", "the columns to project on, row by row", TypeConverters.toList)
    normalize = Param(Params._dummy(), "normalize", "scale the result to unit length", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, matrix: list | None = None, normalize: bool = True):
        super().__init__()
        self._setDefault(outputCol="reduced", normalize=True)
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**given)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        matrix = np.array(self.getOrDefault(self.matrix), np.float64)
        return project(dataset, self.getInputCol(), matrix, self.getOutputCol(), self.getOrDefault(self.normalize))


def fit_reducer(vectors: DataFrame, column: str, k: int = 100, out: str = "reduced", normalize: bool = True) -> VectorReducer:
    """The truncated SVD of a column as a stage that can be saved."""
    _, basis = fit_svd(vectors, column, k)
    return VectorReducer(inputCol=column, outputCol=out, matrix=[[float(x) for x in row] for row in basis], normalize=normalize)
