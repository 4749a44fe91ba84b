"""Vector reduction, k-means, routing, and the streaming operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators import cluster, features, kmeans, pairing
from ..session import scratch_path
from ..streaming import ingest
from . import views as v
from .catalog import Tables, query
from .join_queries import _centroids

# the reference's SVD components (all 64 of the given vectors), restarts and iterations
DIMS, STARTS, STEPS = 100, 16, 300


@query(
    "j_svd",
    "SELECT round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS energy, 64 AS n_values FROM embeddings",
)
def j_svd(t: Tables) -> DataFrame:
    """At full rank the squared singular values add up to the squared norm."""
    values, basis = features.fit_svd(t.embeddings, "embedding", 64)
    vectors = features.project(t.embeddings, "embedding", basis)
    energy = F.aggregate("reduced", F.lit(0.0), lambda acc, x: acc + x * x)
    return vectors.agg(F.round(F.sum(energy), 4).alias("energy"), F.lit(len(values)).alias("n_values"))


@query("j_vectors")
def j_vectors(t: Tables) -> DataFrame:
    return features.reduce_vectors(t.embeddings, "embedding", k=DIMS).select("vec_id", F.size("reduced").alias("dims"))


@query(
    "j_saved_reducer",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS energy, true AS same FROM embeddings""",
)
def j_saved_reducer(t: Tables) -> DataFrame:
    """A reducer inside a pipeline, saved and loaded: at full rank every vector
    keeps its length, and the loaded stage gives what the fitted one gave."""
    from pyspark.ml import Pipeline, PipelineModel

    path = scratch_path(t.spark, "reducer")
    stage = features.fit_reducer(t.embeddings, "embedding", DIMS, normalize=False)
    Pipeline(stages=[stage]).fit(t.embeddings).write().overwrite().save(path)
    again = PipelineModel.load(path).transform(t.embeddings).withColumnRenamed("reduced", "loaded")
    both = stage.transform(again)
    energy = F.aggregate("loaded", F.lit(0.0), lambda acc, x: acc + x * x)
    return both.select("vec_id", F.round(energy, 4).alias("energy"), (F.col("loaded") == F.col("reduced")).alias("same"))


@query("j_kmeans")
def j_kmeans(t: Tables) -> DataFrame:
    reduced = features.reduce_vectors(t.embeddings, "embedding", k=DIMS).select("vec_id", "reduced")
    model = cluster.fit_kmeans(reduced, "reduced", k=10, n_init=STARTS, max_iter=STEPS)
    return cluster.assign(reduced, "reduced", model).groupBy("cluster").agg(F.count("*").alias("n"))


@query("j_kmeans_predict")
def j_kmeans_predict(t: Tables) -> DataFrame:
    """A saved model, loaded again, scores the rows."""
    path = scratch_path(t.spark, "kmeans")
    cluster.fit_kmeans(t.embeddings, "embedding", k=10, n_init=STARTS, max_iter=STEPS).save(t.spark, path)
    return cluster.assign(t.embeddings, "embedding", cluster.Centres.load(t.spark, path)).select("vec_id", "cluster")


# given starts, so that SQL can follow every round: restart r begins with rows r * 5 .. r * 5 + 4
ROUNDS, RESTARTS, K = 4, 3, 5


def _rounds_sql() -> str:
    parts = [
        "e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)",
        f"c0 AS (SELECT vec_id // {K} AS r, vec_id % {K} AS c, i, x FROM e WHERE vec_id < {RESTARTS * K})",
    ]
    for n in range(ROUNDS + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT r, vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, vec_id, c, sum((e.x - c{n}.x) * (e.x - c{n}.x)) AS d
            FROM e JOIN c{n} USING (i) GROUP BY r, vec_id, c) GROUP BY r, vec_id)"""
        )
        if n < ROUNDS:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT r, c, i, coalesce(m, x) AS x FROM c{n} LEFT JOIN
                (SELECT r, c, i, avg(x) AS m FROM a{n} JOIN e USING (vec_id) GROUP BY r, c, i) USING (r, c, i))"""
            )
    return f"""WITH {", ".join(parts)}, k AS (SELECT DISTINCT r, c FROM c0)
    SELECT r::INT AS restart, c::INT AS cluster, (SELECT count(*) FROM a{ROUNDS} a WHERE a.r = k.r AND a.c = k.c) AS n,
      round((SELECT sum(d) FROM a{ROUNDS} a WHERE a.r = k.r), 4) AS cost FROM k"""


@query("j_kmeans_rounds", _rounds_sql())
def j_kmeans_rounds(t: Tables) -> DataFrame:
    """Rows per centre and cost after four rounds of three restarts at once."""
    given = t.embeddings.filter(F.col("vec_id") < RESTARTS * K).orderBy("vec_id").select("embedding").collect()  # 15 rows
    starts = np.array([r["embedding"] for r in given], np.float64).reshape(RESTARTS, K, -1)
    _, counts, costs = kmeans.lloyd(kmeans.pack(t.embeddings, "embedding"), starts, max_iter=ROUNDS, tol=0.0)
    rows = [(r, c, int(counts[r, c]), round(float(costs[r]), 4)) for r in range(RESTARTS) for c in range(K)]
    return t.spark.createDataFrame(rows, "restart int, cluster int, n bigint, cost double")


@query(
    "j_gate_route",
    """WITH c AS (SELECT label, list(m ORDER BY i) AS w FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM
      (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, w), lambda z: z[1]::DOUBLE * z[2])) / 0.5 AS x FROM embeddings e, (SELECT label AS label, w FROM c) AS c2(label, w)),
    s AS (SELECT vec_id, label, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM l)
    SELECT vec_id, arg_max(label, p) AS expert, round(max(p), 6) AS prob FROM s GROUP BY 1""".replace(
        "SELECT vec_id, label, list_sum", "SELECT vec_id, c2.label, list_sum"
    ),
)
def j_gate_route(t: Tables) -> DataFrame:
    vectors = t.embeddings.withColumn("_w", _centroids(t).scalar())
    routed = vectors.select("vec_id", cluster.gate_route(F.col("embedding"), F.col("_w"), 0.5).alias("r"))
    return routed.select("vec_id", "r.expert", F.round("r.prob", 6).alias("prob"))


@query("s_ingest", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def s_ingest(t: Tables) -> DataFrame:
    """Files arrive in two waves; each is taken exactly once."""
    folder, sink, marks = (scratch_path(t.spark, n) for n in ("landing", "sink", "marks"))
    digest = F.md5("text")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for half in (0, 1):
        t.documents.filter(F.col("doc_id") % 2 == half).repartition(4).write.mode("append").parquet(folder)
        out = ingest.incremental_ingest(
            t.spark,
            folder,
            schema,
            sink,
            marks,
            files_per_trigger=2,
            step=lambda df: df.select("doc_id", "lang", digest.alias("digest")),
        )
    return out


@query(
    "s_pairs",
    v.with_("kept") + "SELECT c.page_id, c.rev_id, c.parent_id FROM kept c JOIN kept p ON c.parent_id = p.rev_id",
)
def s_pairs(t: Tables) -> DataFrame:
    """Pairing on a stream of revisions, two files at a time."""
    folder, sink, marks = (scratch_path(t.spark, n) for n in ("revisions", "pairs", "marks"))
    pairing.gate_comments(v.revisions(t)).select("page_id", "rev_id", "parent_id").repartition(4).write.parquet(folder)
    stream = (
        t.spark.readStream.schema("page_id bigint, rev_id bigint, parent_id bigint")
        .option("maxFilesPerTrigger", 2)
        .parquet(folder)
    )
    ingest.drain(ingest.stream_pairs(stream, within=v.PAGE), sink, marks)
    return t.spark.read.parquet(sink)
