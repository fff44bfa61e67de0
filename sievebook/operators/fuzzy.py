"""Approximate names and batch screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, text
from ..functions.similarity import name_score_udf


def variants(rows: DataFrame) -> DataFrame:
    """(id, ord, birthDate, tokens, block) for each name and alias with tokens, by the first two characters of each (M-03)."""
    names = rows.select("id", "ord", "birthDate", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("variant"))
    names = names.withColumn("tokens", text.tokens(F.col("variant"))).where("size(tokens) > 0")
    return names.withColumn("block", F.explode(blocks(F.col("tokens"))))


def blocks(tokens: Column) -> Column:
    return F.array_distinct(F.transform(tokens, lambda t: F.substring(t, 1, 2)))


def birth_adjusted(score: Column, asked: Column, known: Column) -> tuple[Column, Column]:
    """Score and finding after comparing birth dates (M-04)."""
    a, k = F.coalesce(asked.cast("string"), F.lit("")), F.coalesce(known.cast("string"), F.lit(""))
    unknown = (a == "") | (k == "")
    check = F.when(unknown, F.lit(None)).when(a == k, "same").when(F.substring(a, 1, 4) == F.substring(k, 1, 4), "year").otherwise("different")
    return F.when(unknown, score).when(a == k, F.least(F.lit(1.0), score + 0.05)).when(F.substring(a, 1, 4) == F.substring(k, 1, 4), score).otherwise(score * 0.8), check


def find(queries: DataFrame, rows: DataFrame, threshold: Column | float = 0.82, limit: int = 10, birth: str = "birth") -> DataFrame:
    """Best variant of each subject for each (query_id, query, birth), by score, ties in load order (M-04, O-17).

    Candidates share the first two characters of a token. Equal queries are
    one, equal token lists are scored once, and of records of equal tokens and
    birth dates the first ``limit`` are held: later ones cannot be found.
    """
    asked = queries.select("query_id", text.tokens(F.col("query")).alias("q"), F.coalesce(F.col(birth).cast("string"), F.lit("")).alias("asked")).where("size(q) > 0")
    known = variants(rows)
    forms = asked.select("q").distinct().withColumn("block", F.explode(blocks(F.col("q"))))
    scored = forms.join(known.select("tokens", "block").distinct(), "block").select("q", "tokens").distinct().withColumn("base", name_score_udf("q", "tokens"))
    place = F.row_number().over(Window.partitionBy("tokens", "birthDate").orderBy("ord"))
    first = known.select("tokens", "id", "ord", "birthDate").distinct().withColumn("place", place).where(F.col("place") <= limit).drop("place")
    pairs = asked.select("q", "asked").distinct().join(scored, "q").join(first, "tokens")
    score, check = birth_adjusted(F.col("base"), F.col("asked"), F.col("birthDate"))
    best = pairs.withColumns({"score": score, "birthCheck": check}).where(F.col("score") >= threshold)

    def ranked(found: DataFrame, *keys: str) -> DataFrame:
        found = found.groupBy(*keys, "id", "ord").agg(F.max("score").alias("score"), F.max_by("birthCheck", "score").alias("birthCheck"))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord"))
        return found.withColumn("rank", rank).where(F.col("rank") <= limit)

    return ranked(asked.join(ranked(best, "q", "asked").drop("rank"), ["q", "asked"]), "query_id")


def suggestions(found: DataFrame, indexed: DataFrame, q: str, limit: int = 8) -> DataFrame | None:
    """Fuzzy hits beside fewer than three exact ones, if the query has a Latin letter; the limit comes before the other hits are taken out (M-05, X-04, X-05)."""
    few = found.limit(3).count()
    if few >= 3 or not any(c.isascii() and c.isalpha() or "À" <= c <= "ɏ" for c in q):
        return None
    query = indexed.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.lit(q).alias("query"), F.lit(None).cast("string").alias("birth"))
    return find(query, indexed, 0.9 if few else 0.8, limit).join(found.select("id"), "id", "left_anti")


def classify(line: Column) -> tuple[Column, Column, Column]:
    """(kind, key, birth) of a batch line 'query; birth': 13 digits, a document number, or a name (B-01)."""
    query, birth = F.trim(F.get(F.split(line, ";"), F.lit(0))), dates.parse_birth(F.coalesce(F.get(F.split(line, ";"), F.lit(1)), F.lit("")))
    tight = F.regexp_replace(query, r"\s+", "")
    kind = F.when(tight.rlike(r"^\d{13}$"), "idnp").when(tight.rlike(r"(?i)^[a-z]{0,3}\d{6,10}$"), "document").otherwise("name")
    return kind, F.lower(tight), birth


def screen(lines: DataFrame, indexed: DataFrame, threshold: float = 0.88, most: int | None = None) -> DataFrame:
    """row_no, query, birth, kind, status, subject_id, score, birthCheck for each line that is not blank (B-01, J-11, J-12, M-06).

    Of records that share an identifier or document the last loaded counts.
    ``most`` keeps the first so many lines, as an option.
    """
    rows = lines.where(F.trim("raw") != "")
    if most is not None:
        rows = rows.orderBy("row_no").limit(most)
    kind, key, birth = classify(F.col("raw"))
    rows = rows.select("row_no", F.trim(F.get(F.split("raw", ";"), F.lit(0))).alias("query"), birth.alias("birth"), kind.alias("kind"), key.alias("lookup"))
    active = indexed.where("active")
    by_id = active.where("idnp is not null").groupBy(F.col("idnp").alias("lookup")).agg(F.max_by("id", "ord").alias("subject_id")).withColumn("kind", F.lit("idnp"))
    keys = active.select(F.explode("doc_keys").alias("lookup"), "id", "ord").where("length(lookup) >= 6")
    by_doc = keys.groupBy("lookup").agg(F.max_by("id", "ord").alias("subject_id")).withColumn("kind", F.lit("document"))
    exact = rows.where("kind <> 'name'").join(by_id.unionByName(by_doc), ["kind", "lookup"], "left")
    exact = exact.select("row_no", "query", "birth", "kind", F.when(F.col("subject_id").isNotNull(), "exact").otherwise("none").alias("status"), "subject_id", F.when(F.col("subject_id").isNotNull(), 1.0).alias("score"), F.lit(None).cast("string").alias("birthCheck"))
    names = rows.where("kind = 'name'")
    best = find(names.select(F.col("row_no").alias("query_id"), "query", "birth"), active, threshold, 1).select(F.col("query_id").alias("row_no"), F.col("id").alias("subject_id"), "score", "birthCheck")
    strong = (F.col("score") >= 0.97) & (F.coalesce("birthCheck", F.lit("")) != "different")
    status = F.when(F.col("subject_id").isNull(), "none").when(strong, "strong").otherwise("possible")
    named = names.join(best, "row_no", "left").select("row_no", "query", "birth", "kind", status.alias("status"), "subject_id", "score", "birthCheck")
    return exact.unionByName(named)


def tally(results: DataFrame) -> DataFrame:
    """Lines by found, possible, none (G-16)."""
    return results.groupBy(F.when(F.col("status").isin("exact", "strong"), "found").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("count"))
