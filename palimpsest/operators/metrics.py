"""Corpus counts, vocabularies and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bleu as bl
from .ordering import with_index


def label_vocab(labels: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels in code-point order with dense ids from 0."""
    return with_index(labels.select(label).distinct(), [label], "id")


def label_maps(vocab: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """``label, id, i_id``: adopts the ids of a given vocabulary if it holds the
    same labels, else keeps its own; ``i_id`` is the I- counterpart of a B- label."""
    ids = vocab
    if given is not None:
        both = vocab.join(given.select("label", F.col("id").alias("given_id")), "label", "full_outer")
        verdict = both.agg(
            F.coalesce(F.every(F.col("id").isNotNull() & F.col("given_id").isNotNull()), F.lit(True))
        ).scalar()
        ids = both.filter(F.col("id").isNotNull()).select(
            "label", F.when(verdict, F.col("given_id")).otherwise(F.col("id")).alias("id")
        )
    inner = ids.select(F.col("label").alias("_want"), F.col("id").alias("_i"))
    return (
        ids.withColumn(
            "_want", F.when(F.startswith("label", F.lit("B-")), F.replace("label", F.lit("B-"), F.lit("I-")))
        )
        .join(inner, "_want", "left")
        .select("label", "id", F.coalesce("_i", "id").alias("i_id"))
    )


def corpus_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("src") != F.col("tgt")).alias("changed"),
        F.count_if(F.col("src") == F.col("tgt")).alias("unchanged"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def entity_metrics(tokens: DataFrame) -> DataFrame:
    """Per-label and overall precision, recall, F1 and support.

    ``tokens`` has ``gold, pred`` per kept position; every token is an entity
    of its own. The ``overall`` row is the micro average.
    """
    sides = tokens.select(
        F.explode(
            F.when(
                F.col("gold") == F.col("pred"),
                F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("tp"), F.lit(1).alias("p"), F.lit(1).alias("g"))),
            ).otherwise(
                F.array(
                    F.struct(F.col("gold").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("p"), F.lit(1).alias("g")),
                    F.struct(F.col("pred").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("p"), F.lit(0).alias("g")),
                )
            )
        ).alias("x")
    ).select("x.*")
    sums = sides.rollup("label").agg(
        F.sum("tp").alias("tp"), F.sum("p").alias("n_pred"), F.sum("g").alias("support"), F.grouping("label").alias("all")
    )
    p, r = _ratio(F.col("tp"), F.col("n_pred")), _ratio(F.col("tp"), F.col("support"))
    return sums.select(
        F.when(F.col("all") == 1, "overall").otherwise(F.col("label")).alias("label"),
        p.alias("precision"),
        r.alias("recall"),
        F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1"),
        "support",
    )


def slot_accuracy(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("accuracy"))


def perplexity(losses: DataFrame, loss: str = "loss") -> DataFrame:
    return losses.agg(F.exp(F.avg(loss)).alias("perplexity"))


def metrics_json(metrics: DataFrame, prefix: str = "eval_") -> DataFrame:
    """One flat JSON object ``{prefix + label_metric: value}``; the number of
    labels bounds its size."""
    long = metrics.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.concat(F.lit(prefix), F.col("label"), F.lit("_" + m)).alias("key"),
                        F.col(m).cast("double").alias("value"),
                    )
                    for m in ("precision", "recall", "f1", "support")
                ]
            )
        ).alias("e")
    ).select("e.*")
    return long.agg(
        F.to_json(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value"))))
        ).alias("metrics")
    )


def corpus_bleu(pairs: DataFrame) -> DataFrame:
    """One score over all pairs of token arrays ``ref, hyp``.

    Clipped counts are taken per pair as multiset intersections and summed, so
    only four numbers per row are aggregated: no n-gram is shuffled.
    """
    orders = range(1, bl.MAX_ORDER + 1)
    profiles = pairs.select(bl.profile(F.col("ref")).alias("r"), bl.profile(F.col("hyp")).alias("h"))
    per_row = profiles.select(
        *[F.size(F.array_intersect(f"r.g{n}", f"h.g{n}")).alias(f"m{n}") for n in orders],
        *[F.greatest(F.col("h.len") - (n - 1), F.lit(1)).alias(f"t{n}") for n in orders],
        F.col("r.len").alias("r"),
        F.col("h.len").alias("h"),
    )
    sums = per_row.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per_row.columns])
    score = bl.combine(
        [F.col(f"m{n}") for n in orders], [F.col(f"t{n}") for n in orders], F.col("r"), F.col("h")
    )
    return sums.select(*[F.col(f"m{n}") for n in orders], score.alias("bleu"))


def token_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    from ..functions.text import words

    return docs.select(key, F.size(words(F.col(text))).alias("token_count"))
