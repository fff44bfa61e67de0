"""Sinks."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import labels


def _plain(value):
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    raise TypeError(type(value))


def payload(df: DataFrame, name: str, generated_at: str, indent: int | None = None) -> str:
    """A small table as one JSON document with a trailing newline (K-01, K-02)."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    separators = None if indent else (",", ":")
    return json.dumps({"generatedAt": generated_at, name: rows}, ensure_ascii=False, indent=indent, separators=separators, default=_plain) + "\n"


def write_details(details: DataFrame, path: str) -> None:
    """Details by decision (K-03)."""
    details.write.mode("overwrite").partitionBy("decisionId").json(path)


def lookups(rows: DataFrame, generated_at: str) -> DataFrame:
    """One row per identifier with its records (K-04, J-15)."""
    record = F.struct("ord", "id", "decisionId", "name", "regime", "applied")
    out = rows.where("idnp is not null and idnp <> ''").groupBy("idnp").agg(F.array_sort(F.collect_list(record)).alias("records"), F.min_by("name", "ord").alias("subject"))
    return out.select("idnp", F.lit(True).alias("listed"), F.lit(generated_at).alias("checkedAgainst"), "subject", "records")


def cell(value: Column, delimiters: str = ',"\r\n') -> Column:
    """One CSV cell, quoted where needed; null is empty (K-05, K-06)."""
    x = F.coalesce(value.cast("string"), F.lit(""))
    special = "[" + "".join({"\r": "\\r", "\n": "\\n"}.get(c, c) for c in delimiters) + "]"
    return F.when(x.rlike(special), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_line(columns: list[Column], delimiters: str = ',"\r\n') -> Column:
    return F.concat_ws(",", *(cell(c, delimiters) for c in columns))


def joined(values: Column) -> Column:
    """Arrays in CSV (K-05)."""
    return F.concat_ws("; ", values)


# Heads of the three exports, and words for what a batch line found.
FULL = ["id", "nume", "aliasuri", "tip", "data_nasterii", "idnp", "documente", "cetatenie", "regim", "decizie_cis", "data_deciziei", "aplicat_rm", "inclus_la_sursa", "masuri", "functie", "pagina_pdf"]
BROWSER = ["Nume", "Aliasuri", "Tip", "Data nașterii", "IDNP", "Documente", "Cetățenie", "Regim", "Decizie", "Dată decizie", "Aplicat în RM", "Inclus la sursă", "Măsuri", "Pagină PDF", "Link"]
BATCH = ["Rând", "Căutat", "Data nașterii introdusă", "Tip", "Rezultat", "Asemănare", "Subiect", "Data nașterii subiect", "Regim", "Decizie", "Link"]
BATCH_KINDS = {"idnp": "IDNP", "document": "Document", "name": "Nume"}
#: What makes the browser's exports quote a cell.
BROWSER_SIGNS = '",\n;'
_BOM = "\ufeff"


def _deciding(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.col("id").alias("decisionId"), F.col("number").alias("_number"), F.col("date").alias("_date"), F.col("measures").alias("_measures"))


def _or_none(values: Column, kind: str = "string") -> Column:
    return F.coalesce(values, F.array().cast(f"array<{kind}>"))


def full_lines(subjects: DataFrame, details: DataFrame, decisions: DataFrame) -> DataFrame:
    """(ord, line): a record of the full CSV (K-05)."""
    docs = F.transform(_or_none(F.col("documents"), schemas.DOCUMENT), lambda d: F.trim(F.concat(d["kind"], F.lit(" "), F.coalesce(d["series"], F.lit("")), d["number"])))
    rows = subjects.join(_deciding(decisions), "decisionId").join(details.select("id", "function"), "id", "left")
    c = F.col
    cells = [c("id"), c("name"), joined(c("aliases")), c("type"), c("birthDate"), c("idnp"), joined(docs), joined(c("citizenship")), c("regime"), c("_number"), c("_date"), c("listing.md"), c("listing.foreign"), joined(c("_measures")), c("function"), F.when(c("page") != 0, c("page"))]
    return rows.select("ord", csv_line(cells).alias("line"))


def browser_lines(rows: DataFrame, decisions: DataFrame, base: str) -> DataFrame:
    """(ord, line): a hit in the export of a search, with labels and link (K-06)."""
    docs = F.transform(_or_none(F.col("documents"), schemas.DOCUMENT), labels.document)
    measures = F.transform(_or_none(F.col("_measures")), lambda m: labels.labelled(m, labels.MEASURES))
    own = rows.drop("_number", "_date", "_measures").join(_deciding(decisions), "decisionId", "left")
    c = F.col
    cells = [c("name"), joined(c("aliases")), labels.labelled(c("type"), labels.TYPES), c("birthDate"), c("idnp"), joined(docs), joined(c("citizenship")), c("regime"), labels.decision(c("_number"), c("_date")), c("_date"), c("listing.md"), c("listing.foreign"), joined(measures), c("page"), F.concat(F.lit(f"{base}#/subiect/"), c("id"))]
    return own.select("ord", csv_line(cells, BROWSER_SIGNS).alias("line"))


def batch_lines(results: DataFrame, subjects: DataFrame, decisions: DataFrame, base: str, words: dict[str, str]) -> DataFrame:
    """(row_no, line) of the results of fuzzy.screen, statuses told in ``words`` (K-07)."""
    own = subjects.select(F.col("id").alias("subject_id"), "name", "birthDate", "regime", "decisionId")
    rows = results.join(own, "subject_id", "left").join(_deciding(decisions), "decisionId", "left")
    c, known = F.col, F.col("name").isNotNull()
    link = F.when(known, F.concat(F.lit(f"{base}#/subiect/"), c("subject_id")))
    cells = [c("row_no"), c("query"), c("birth"), labels.labelled(c("kind"), BATCH_KINDS), labels.labelled(c("status"), words), F.when(c("score") > 0, labels.percent(c("score"))), c("name"), c("birthDate"), c("regime"), F.when(known & c("decisionId").isNotNull(), labels.decision(c("_number"), c("_date"))), link]
    return rows.select("row_no", csv_line(cells, BROWSER_SIGNS).alias("line"))


def write_lines(lines: DataFrame, order: str, head: list[str], path: str, end: str = "\r\n") -> None:
    """A CSV of lines in order, with a byte order mark and a head. Its parts, one after the other by name, are the file (K-05 with CRLF, K-06 and K-07 with LF)."""
    top = lines.sparkSession.range(1).select(F.lit(_BOM + ",".join(head)).alias("line"))
    top.unionByName(lines.orderBy(order).select("line")).write.mode("overwrite").option("lineSep", end).text(path)


def manifest(spark, version: str, generated_at: str, counts: dict[str, int], endpoints: list[str]) -> DataFrame:
    """K-08."""
    return spark.createDataFrame([(version, generated_at, counts, endpoints)], "version string, generatedAt string, counts map<string,long>, endpoints array<string>")


def rebuild(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Replace a published table; the commit protocol keeps readers from half-written files (K-09)."""
    df.write.mode("overwrite").format(format).save(path)
