"""Response scoring on Spark: ingest, clean, gate, features, ordered scores, agreement."""
