"""The validation gate: expectations of a registry as rows, so that none is written in code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPECTATION = "idnp string, decisionId string, reason_length int, document string"


class ValidationError(Exception):
    """Expectations that a registry does not meet."""


def problems(records: DataFrame, expectations: DataFrame) -> DataFrame:
    """idnp and problem of each expectation not met: missing, decision, reason, document.

    records has idnp, decisionId, reason, documents; an expectation has idnp
    and may leave its other columns null. Of an identifier's records those of
    the expected decision are judged; nothing else is asked of one that is
    missing or of another decision.
    """
    e, r = expectations.alias("e"), records.alias("r")
    linked = F.coalesce(F.col("e.decisionId") == F.col("r.decisionId"), F.col("e.decisionId").isNull())
    number = F.exists(F.coalesce("r.documents", F.array().cast(records.schema["documents"].dataType)), lambda d: d["number"] == F.col("e.document"))
    joined = e.join(r, F.col("e.idnp") == F.col("r.idnp"), "left").groupBy("e.idnp", "e.decisionId", "e.reason_length", "e.document").agg(
        F.count("r.idnp").alias("n"),
        F.count_if(F.col("r.idnp").isNotNull() & linked).alias("linked"),
        F.max(F.when(linked, F.length(F.coalesce("r.reason", F.lit(""))))).alias("longest"),
        F.bool_or(linked & F.coalesce(number, F.lit(False))).alias("has"),
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("n") == 0, "missing"),
            F.when((F.col("n") > 0) & (F.col("linked") == 0), "decision"),
            F.when((F.col("linked") > 0) & (F.col("longest") < F.col("reason_length")), "reason"),
            F.when((F.col("linked") > 0) & F.col("document").isNotNull() & ~F.coalesce("has", F.lit(False)), "document"),
        )
    )
    return joined.select("idnp", F.explode(found).alias("problem"))


def require(records: DataFrame, expectations: DataFrame) -> None:
    """Raises ValidationError naming the problems; their number is at most four an expectation."""
    rows = problems(records, expectations).orderBy("idnp", "problem").collect()
    if rows:
        raise ValidationError("; ".join(f"{r.idnp}: {r.problem}" for r in rows))
