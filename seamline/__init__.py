"""Visual-inspection analytics on Spark: verdicts, records, datasets, identity, anomaly maps, capture."""
