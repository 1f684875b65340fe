"""Operations of a large-scale training-data pipeline, each a Spark job of its own."""
