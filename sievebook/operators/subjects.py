"""Subjects from raw records, and the names that are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, extract, names
from ..functions.decisions import listed_in
from ..functions.text import clean_ws, fold, let, strip
from ..schemas import DETAIL, SUBJECT
from ..tasks import spread

# Labels of the fields, and what ends each.
BIRTH = r"Data na[sș]terii|n[aă]scut[ăa]?\s+la(?:\s+data\s+de)?"
BIRTH_STOPS = "Locul|Sex|Cet|Func|Num|IDNP|Pozi"
FIELDS = {
    "birthPlace": ("Locul na[sș]terii", "Sex|Cet|Func|Num|IDNP|Gen|Pozi|Alte"),
    "gender": ("Sexul|Genul|Gen", "Cet|Func|Num|IDNP|Locul|Data|Pozi"),
    "citizenship": (r"Cet[aă][tț]eni[ae]|Na[tț]ionalitate(?:\(i\))?", "Num|IDNP|Func|Sex|Pa[sș]aport|Buletin|Gen|Pozi|Data|Locul"),
    "function": ("Func[tț]i[ae]|Pozi[tț]ie|Funcție", "Data|Locul|Sex|Cet|Num|IDNP|Adres|Tip de|Na[tț]ional"),
}


def _birth(info: Column, whole: Column) -> Column:
    """The labelled date, without label the first date of the info, else the labelled date anywhere in the record (F-07)."""
    own = extract.field_after(info, BIRTH, BIRTH_STOPS)
    anywhere = extract.field_after(whole, BIRTH, BIRTH_STOPS + "|este titular")
    return F.coalesce(dates.parse_numeric_date(F.when(own == "", info).otherwise(own)), dates.parse_numeric_date(anywhere))


def build_subjects(records: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subjects, details, rejected) of raw records and their decisions.

    records has file, ord (the place in its file, from 1), listNumber, type,
    name, info, reason, notes, page, and dates if the list has such a column;
    decisions has file, id, kind, regime, status; those that are not listed_in
    give no rows (P-09). Subjects and details have the
    columns of ``schemas``, without the subjects' load order. rejected has
    file, ord, name and warning of the records whose name is none (P-10).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = decisions.where(listed_in(F.struct("kind", "status"))).select("file", F.col("id").alias("decisionId"), "regime", (F.col("status") == "in_force").alias("active"))
    # A record takes long: a small file of many is dealt to all tasks.
    records = spread(records, "file", "ord")
    raw = records if "dates" in records.columns else records.withColumn("dates", F.lit(""))
    raw = raw.select("file", "ord", "listNumber", "page", F.col("type").alias("declared"), *(text(c).alias(c) for c in ("name", "info", "reason", "dates", "notes"))).join(own, "file")
    raw = raw.withColumns({"whole": F.concat_ws(" ", "name", "info", "reason", "dates", "notes"), "split": names.split_aliases(F.col("name"))})
    # The filter on names that are none is pushed down to the records with all it reads: each value is named once (let), or the plan grows manifold.
    raw = raw.withColumn("labelled", F.when(F.col("info") == "", F.col("whole")).otherwise(F.col("info")))
    raw = raw.withColumns({"main": let(F.col("split.name"), lambda n: F.when(n != "", n).otherwise(clean_ws(F.when(F.col("name") == "", "Fără nume").otherwise(F.col("name"))))), "idnp": F.coalesce(extract.parse_idnp(F.col("info")), extract.parse_idnp(F.col("name")))})
    raw = raw.withColumns({k: extract.field_after(F.col("labelled"), *v) for k, v in FIELDS.items()})
    # The dates of a list without a column of dates stand in the other texts (F-05).
    listed = raw.withColumns({"first": extract.parse_listing(F.concat_ws(" ", "dates", F.substring("reason", 1, 200))), "more": extract.parse_listing(F.concat_ws(" ", "info", "reason"))})
    foreign = F.when(F.col("first.md").isNull(), F.coalesce("first.foreign", "more.foreign")).otherwise(F.col("first.foreign"))
    listed = listed.withColumn("listing", F.struct(foreign.alias("foreign"), F.coalesce("first.md", "more.md").alias("md")))
    typed = listed.withColumns({"type": extract.refine_type(F.col("declared"), F.col("main"), F.col("info")), "citizenship": F.when(F.col("citizenship") == "", F.array().cast("array<string>")).otherwise(extract.citizenship(F.col("citizenship")))})
    final = let(F.col("main"), lambda m: F.when(F.col("type") == "person", F.regexp_replace(m, r"(?U)\s+\d{1,2}\*?$", "")).otherwise(m))
    local = F.col("idnp").isNotNull() | F.exists("citizenship", lambda c: fold(c).contains("moldova"))
    out = typed.withColumns({"id": F.concat_ws("-", "decisionId", "ord"), "raw_name": F.col("name"), "name": final, "moldova": local, "page": F.when(F.col("page") > 0, F.col("page")).otherwise(1).cast("int")})
    out = out.withColumns({
        "aliases": F.col("split.aliases"),
        "birthDate": _birth(F.col("info"), F.col("whole")),
        "listNumber": F.when(F.col("listNumber") != "", F.col("listNumber")).otherwise(F.col("ord").cast("string")),
        "documents": extract.parse_documents(F.concat_ws("\n", "info", "raw_name"), F.col("idnp")),
        "gender": F.substring(strip(F.col("gender"), " :"), 1, 40),
        "reason": extract.clean_reason(F.col("reason")),
        "notes": clean_ws(F.col("notes")),
        "identifiersText": clean_ws(F.col("info")),
        "listingRaw": F.col("first.raw"),
        "bad": extract.is_bad_name(F.col("name")),
    })
    columns = lambda schema: [x for x in records.sparkSession.createDataFrame([], schema).columns if x != "ord"]
    kept = out.where(~F.col("bad"))
    rejected = out.where("bad").select("file", "ord", "name", F.concat(F.lit("nume_respins_"), F.col("ord")).alias("warning"))
    return kept.select(*columns(SUBJECT)), kept.select(*columns(DETAIL)), rejected


def with_rejected(report: DataFrame, rejected: DataFrame) -> DataFrame:
    """The report of ``narrative.choose`` with the warnings of rejected names, in their order, and without them in its count (P-10)."""
    found = rejected.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "warning"))), lambda r: r["warning"]).alias("_more"))
    joined = report.join(found, "file", "left").withColumn("_more", F.coalesce("_more", F.array().cast("array<string>")))
    return joined.withColumns({"subjects": F.col("subjects") - F.size("_more"), "warnings": F.concat("warnings", "_more")}).drop("_more")
