"""Garment identity: profiles from reference embeddings, and identification against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seamline import schema as S
from seamline.functions.scores import (
    IDENTITY_MARGIN,
    IDENTITY_MAX,
    IDENTITY_MIN,
    IDENTITY_PERCENTILE,
    identity_threshold,
)
from seamline.operators.images import embed_images
from seamline.operators.nearest import nearest
from seamline.operators.quantiles import exact_percentile
from seamline.session import cut_lineage

TOP_K = 3
MIN_IMAGES = 10


def _mean_of_best(score: str = "score") -> Column:
    """Mean of the few best scores, added up from the smallest: the same value whatever order they arrive in."""
    few = F.array_sort(F.collect_list(score))
    return F.aggregate(few, F.lit(0.0), lambda total, x: total + x) / F.size(few)


def similarity(queries: DataFrame, gallery: DataFrame, k: int = TOP_K, **blocking) -> DataFrame:
    """Mean of the ``k`` best similarities of each query to each model.

    ``queries``: query_id, embedding; ``gallery``: item_id, model_name, embedding.
    """
    best = nearest(queries, gallery, k, group="model_name", **blocking)
    return best.groupBy("query_id", "model_name").agg(_mean_of_best().alias("similarity"))


def internal_scores(gallery: DataFrame, k: int = TOP_K, **blocking) -> DataFrame:
    """Similarity of each reference image to the others of its own model (leave one out)."""
    queries = gallery.select(F.col("item_id").alias("query_id"), "model_name", "embedding")
    best = nearest(
        queries, gallery, k, group="model_name", same_group=True, skip_self=True, **blocking
    )
    scored = best.groupBy("model_name", "query_id").agg(_mean_of_best().alias("score"))
    return scored.withColumnRenamed("query_id", "item_id")


def profiles(
    gallery: DataFrame,
    k: int = TOP_K,
    percentile: float = IDENTITY_PERCENTILE,
    margin: float = IDENTITY_MARGIN,
    low: float = IDENTITY_MIN,
    high: float = IDENTITY_MAX,
    min_images: int = MIN_IMAGES,
    **blocking,
) -> DataFrame:
    """Threshold and internal figures of every model that has enough images."""
    scores = internal_scores(gallery, k, **blocking)
    stats = exact_percentile(scores, ["model_name"], "score", "item_id", percentile)
    return stats.filter(F.col("n") >= min_images).select(
        "model_name",
        "n",
        F.col("min_value").alias("min_sim"),
        F.col("mean_value").alias("mean_sim"),
        identity_threshold(F.col("percentile"), margin, low, high).alias("threshold"),
    )


def build_profiles(images: DataFrame, make_predict_fn, side: int = 224, **options) -> tuple[DataFrame, DataFrame]:
    """(gallery, profile) of reference images: model_name, image_name and the image fields.

    Unreadable images are left out; a model needs enough readable ones. The embeddings are written out
    once, as both results use them.
    """
    embedded = embed_images(images, ["model_name", "image_name"], make_predict_fn, side)
    gallery = cut_lineage(embedded.withColumn("item_id", F.xxhash64("model_name", "image_name")))
    return gallery, profiles(gallery, **options)


def compare(similarities: DataFrame, profile: DataFrame) -> DataFrame:
    """Each (query, model) pair with the model's threshold and whether it is reached.

    A model without a profile has no threshold, and nothing reaches it.
    """
    known = profile.select("model_name", "threshold")
    joined = similarities.join(known, "model_name", "left")
    return joined.withColumn("identified", F.coalesce(F.col("similarity") >= F.col("threshold"), F.lit(False)))


def identify(
    queries: DataFrame, gallery: DataFrame, profile: DataFrame, k: int = TOP_K, **blocking
) -> DataFrame:
    """The best model that reaches its threshold, per query; otherwise unidentified.

    Decided on unrounded values. An unidentified query reports the figures of its most similar model among
    those with a profile, and no figures if there is none: every query has a row.
    """
    pairs = compare(similarity(queries, gallery, k, **blocking), profile).where("threshold is not null")
    rank = F.struct("identified", "similarity", "model_name")
    pair = F.struct("model_name", "similarity", "threshold", "identified")
    found = pairs.groupBy("query_id").agg(F.max_by(pair, rank).alias("best"))
    asked = queries.select("query_id").distinct()
    best = asked.join(found, "query_id", "left").select("query_id", "best.*")
    best = best.withColumn("identified", F.coalesce("identified", F.lit(False)))

    def when_known(value: Column) -> Column:
        return F.when(F.col("identified"), value)

    return best.select(
        "query_id",
        "identified",
        when_known(F.col("model_name")).alias("model_name"),
        F.coalesce(when_known(F.col("model_name")), F.lit(S.UNIDENTIFIED_RESULT)).alias("result"),
        F.round("similarity", 4).alias("similarity"),
        F.round("threshold", 4).alias("threshold"),
    )
