"""Records from running text, and the choice between them and a table's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.extract import page_of
from ..functions.rows import narrative_fields, section_type
from ..functions.text import clean_ws, strip

_ENTRY = r"(?sU)^(\d{1,4})\.\s+(.+)$"
_NOTE = r"(?iusU)^(.*?)(?:^|\n)\s*\d{1,2}\s+(Precizare necesară.+)$"
#: A number so much above the one before is part of a text.
LEAP = 20


def annex(text: Column) -> Column:
    """The text from the word LISTA on; empty without it."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?sU)\bLISTA\b.*", 0)


def is_empty_annex(annexed: Column) -> Column:
    """An ellipsis in brackets and no numbered line (L-15)."""
    return annexed.rlike(r"(?U)\[\s*(?:…|\.\.\.)\s*\]") & ~annexed.rlike(r"(?mU)^\s*\d+\.\s+\S")


def extract_narrative(files: DataFrame) -> DataFrame:
    """file, ord, listNumber, type, name, info, reason, notes, page of the entries of each file's list (L-13).

    files has file and text; a file's text is one row and its entries are
    gathered once, to tell numbers of entries from numbers in their texts. A
    null text, one without list and one whose annex is empty give no rows.
    """
    chunks = F.split(F.col("annex"), r"(?mU)^(?=\s*(?:[A-Z]\.\s+\S.{0,80}|[IVX]{1,4}\.\s+\S.{0,80}|\d{1,4}\.\s+\S))")
    lists = files.select("file", "text", annex(F.col("text")).alias("annex")).where((F.col("annex") != "") & ~is_empty_annex(F.col("annex")))
    pieces = lists.select("file", F.posexplode(F.transform(chunks, lambda c: strip(c))).alias("at", "chunk")).where("chunk <> ''")
    line = F.split("chunk", "\n", 2)
    titled = pieces.withColumn("section", F.when(~F.col("chunk").rlike(r"(?U)^\d+\."), section_type(F.get(line, F.lit(0)))))
    titled = titled.withColumn("chunk", F.when(F.col("section").isNull(), F.col("chunk")).otherwise(strip(F.coalesce(F.get(line, F.lit(1)), F.lit("")))))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = titled.withColumn("type", F.coalesce(F.last("section", ignorenulls=True).over(before), F.lit("person"))).where(F.col("chunk").rlike(_ENTRY))
    numbered = numbered.select("file", "at", "type", "chunk", F.regexp_extract("chunk", _ENTRY, 1).alias("number"))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        number = r["number"].cast("int")
        opens = s["last"].isNull() | (number <= s["last"] + LEAP)
        n = s["n"] + F.when(opens, 1).otherwise(0)
        return F.struct(F.when(opens, number).otherwise(s["last"]).alias("last"), n.alias("n"), F.array_append(s["out"], n).alias("out"))

    held = numbered.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "number", "type", "chunk"))).alias("rows"))
    records = held.withColumn("ord", F.aggregate("rows", start, step, lambda s: s["out"])).select("file", F.explode(F.arrays_zip("rows", "ord")).alias("z")).select("file", "z.rows.*", "z.ord")
    joined = records.groupBy("file", "ord").agg(F.min(F.struct("at", "number", "type", "chunk")).alias("head"), F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("all"))
    raw = F.regexp_extract("head.chunk", _ENTRY, 2)
    parted = joined.select("file", "ord", F.col("head.number").alias("listNumber"), F.col("head.type").alias("type"), raw.alias("raw"), F.transform(F.slice("all", 2, F.size("all")), lambda x: x["chunk"]).alias("more"))
    parted = parted.withColumn("notes", clean_ws(F.regexp_extract("raw", _NOTE, 2)))
    fields = parted.withColumn("fields", narrative_fields(clean_ws(F.when(F.col("notes") == "", F.col("raw")).otherwise(F.regexp_extract("raw", _NOTE, 1)))))
    info = F.when(F.size("more") > 0, clean_ws(F.concat_ws(" ", "fields.info", F.concat_ws(" ", "more")))).otherwise(F.col("fields.info"))
    out = fields.select("file", "ord", "listNumber", "type", F.col("fields.name").alias("name"), info.alias("info"), F.col("fields.reason").alias("reason"), "notes")
    return out.join(lists.select("file", "text"), "file").withColumn("page", page_of(F.col("text"), F.substring("name", 1, 40))).drop("text")


def choose(files: DataFrame, tables: DataFrame, narratives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the records used, with method; file, method, subjects and warnings of each file) (L-14).

    files has file, text and ocr. A file's table counts first, unless its text
    is from pictures; without it its running text. tables and narratives have
    the same columns, file among them; rows of other files are not used.
    """
    n = lambda rows, name: rows.groupBy("file").agg(F.count("*").alias(name))
    counted = files.select("file", "text", F.coalesce("ocr", F.lit(False)).alias("ocr")).join(n(tables, "_t"), "file", "left").join(n(narratives, "_n"), "file", "left")
    table, running = ~F.col("ocr") & (F.coalesce("_t", F.lit(0)) > 0), F.coalesce("_n", F.lit(0)) > 0
    method = F.when(table, "table").when(running & F.col("ocr"), "ocr_narrative").when(running, "narrative").when(F.col("ocr"), "skipped").otherwise("table_empty")
    text = F.coalesce("text", F.lit(""))
    a = annex(text)
    reason = F.when(a == "", "fara_lista").when(is_empty_annex(a), "anexa_goala").otherwise("narativ_fara_intrari")
    none = ~table & ~running
    scanned = F.when(F.col("ocr"), "ocr"), F.when(F.col("ocr") & (F.length(strip(text)) < 40), "ocr_gol")
    warnings = F.array_compact(F.array(*scanned, F.when(none, reason), F.when(none & (reason == "narativ_fara_intrari"), "fara_subiecti")))
    report = counted.select("file", method.alias("method"), F.when(table, F.col("_t")).when(running, F.col("_n")).otherwise(0).cast("long").alias("subjects"), warnings.alias("warnings"))
    named = report.select("file", "method")
    used = tables.join(named.where("method = 'table'"), "file").unionByName(narratives.join(named.where("method in ('narrative', 'ocr_narrative')"), "file"))
    return used, report
