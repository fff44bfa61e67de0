"""SQL functions of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions.similarity import jaro_winkler_udf, name_score_udf


def register(spark: SparkSession) -> None:
    """Adds jaro_winkler(a, b) and name_score(query tokens, name tokens) to the session."""
    spark.udf.register("jaro_winkler", jaro_winkler_udf)
    spark.udf.register("name_score", name_score_udf)
