"""The search around the matched bank items starts from what the first search found, without making that again."""

import numpy as np
import pandas as pd

from seamline.operators import anomaly


def test_first_search_is_made_once(spark, monkeypatch):
    asked, nearest = [], anomaly.nearest
    monkeypatch.setattr(anomaly, "nearest", lambda queries, *args, **more: asked.append(queries) or nearest(queries, *args, **more))
    vectors = list(np.random.default_rng(1).normal(size=(40, 4)).astype(np.float32))
    bank = spark.createDataFrame(pd.DataFrame({"item_id": np.arange(40), "embedding": vectors}), "item_id long, embedding array<float>")
    patches = bank.selectExpr("item_id div 8 AS image_id", "item_id AS patch_id", "embedding")
    assert anomaly.image_scores(patches, bank, skip_self=True).count() == 5
    assert len(asked) == 2
    assert "InArrow" not in asked[1]._jdf.queryExecution().toString()
