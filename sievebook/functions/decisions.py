"""What a decision's file says of itself as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_ro_date
from .text import clean_ws, fold, let

# Numbers of decisions whose kind or status their text does not tell.
AMENDMENTS = [18, 25, 28, 29, 30, 33, 39, 44, 47, 48, 52]
ALIGNMENTS = [23, 31, 35, 37]
REPEALED = [3]
# Beginnings of folded titles, the first that fits counts.
THEME_PREFIXES = [
    "punerea in aplicare a masurilor restrictive internationale ale uniunii europene",
    "punerea in aplicare a masurilor restrictive internationale ale regatului unit al marii britanii si irlandei de nord",
    "punerea in aplicare a masurilor restrictive internationale ale regatului unit al marii britanii si al irlandei de nord",
    "punerea in aplicare a masurilor restrictive internationale ale statelor unite ale americii",
    "punerea in aplicare a masurilor restrictive internationale ale canadei",
    "punerea in aplicare a masurilor restrictive internationale",
    "alinierea la unele masuri restrictive internationale ale",
    "alinierea la masurile restrictive internationale ale",
    "alinierea la uncle masuri restrictive internationale ale",
    "modificarea unor decizii de punere in aplicare a masurilor restrictive internationale ale uniunii europene",
    "modificarea deciziei consiliului interinstitutional de supervizare",
]
# Parts of folded texts that name a regime or a measure.
REGIMES = [("UK", "regatului unit|marii britanii"), ("SUA", "statelor unite"), ("Canada", "canad"), ("ONU", r"natiunilor unite|\bonu\b"), ("UE", "uniunii europene|pesc")]
MEASURES = [
    ("asset_freeze", "blocarea fondurilor|blocare a fondurilor"),
    ("travel_ban", "restrictiilor de calatorie|interzice intrarea|interdictie de intrare"),
]
INSTRUMENT = r"(?iu)(Decizia\s*\(PESC\)\s*\d{4}/\d+|Decizia\s+\d{4}/\d+/PESC|S\.I\.\s*\d{4}/\d+|SOR/\d{4}-\d+)"

_NUMBER = r"(?iusU)nr\.?\s*(\d{1,3})\s+din\s+(.+?)(?:Priv|MODIFICAT|DECIDE)"
_TITLE = r"(?iusU)Priv\w+\s+(.+?)(?:\n\s*MODIFICAT|\bMODIFICAT\b|[ÎI]n conformitate|\bDECIDE\b)"


def theme(title: Column) -> Column:
    """The folded title after the first prefix that leaves something, at most 180 characters (T-10)."""

    def of(f: Column) -> Column:
        rests = [(f.startswith(p), F.trim(F.substr(f, F.lit(len(p) + 1)))) for p in THEME_PREFIXES]
        return F.coalesce(*(F.when(fits & (rest != ""), F.substring(rest, 1, 180)) for fits, rest in rests), F.when(f != "", F.substring(f, 1, 180)), F.lit("nedeterminat"))

    return let(fold(title), of)


def decision_number(name: Column) -> Column:
    """The number after 'nr.' or 'cis' in a file name (F-16)."""
    return F.regexp_extract(name, r"(?i)(?:nr\.?\s*|cis\s+)(\d{1,3})", 1).try_cast("int")


def regime(title: Column, head: Column) -> Column:
    """The first regime that the title or the first 2,500 characters of the head name (F-14)."""

    def of(x: Column) -> Column:
        return F.coalesce(*(F.when(x.rlike(pattern), name) for name, pattern in REGIMES), F.lit("Altele"))

    return let(fold(F.concat_ws(" ", title, F.substring(head, 1, 2500))), of)


def measures(text: Column) -> Column:
    """Measures named in the first 20,000 characters (F-15)."""
    return let(fold(F.substring(text, 1, 20000)), lambda x: F.array_compact(F.array(*(F.when(x.rlike(pattern), name) for name, pattern in MEASURES))))


def kind(file: Column, number: Column, title: Column) -> Column:
    """Report, amendment, alignment or implementation, in this precedence (F-13)."""
    listed = lambda numbers: F.coalesce(number.isin(numbers), F.lit(False))

    def of(t: Column) -> Column:
        return (
            F.when(F.contains(F.upper(file), F.lit("RAPORT")), "report")
            .when(t.startswith("modificarea") | (listed(AMENDMENTS) & ~t.startswith("punerea")), "amendment")
            .when(t.startswith("aliniere") | listed(ALIGNMENTS), "alignment")
            .otherwise("implementation")
        )

    return let(fold(title), of)


def classify(path: Column, text: Column) -> Column:
    """Struct of id, number, date, title, theme, regime, kind, status, measures, amendedBy, instruments (F-12).

    Number and date come from the head 'nr. N din DATE', else from the file's
    name and the head; a null text is empty.
    """
    text = F.coalesce(text, F.lit(""))
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    head = F.substring(text, 1, 6000)

    def first(x: Column) -> Column:
        named = F.regexp_extract(x["head"], _NUMBER, 1).try_cast("int")
        title = F.regexp_extract(x["head"], _TITLE, 1)
        return F.struct(
            x["head"].alias("head"),
            F.coalesce(named, decision_number(file)).alias("number"),
            parse_ro_date(F.when(named.isNull(), x["head"]).otherwise(F.regexp_extract(x["head"], _NUMBER, 2))).alias("date"),
            F.when(title == "", stem).otherwise(clean_ws(title)).alias("title"),
        )

    def whole(x: Column) -> Column:
        repealed = F.coalesce(x["number"].isin(REPEALED), F.lit(False)) | x["head"].rlike(r"(?U)\bAbrogat")
        found = F.regexp_extract_all(F.substring(text, 1, 15000), F.lit(INSTRUMENT), F.lit(1))
        return F.struct(
            F.coalesce(x["number"].cast("string"), stem).alias("id"), x["number"].alias("number"), x["date"].alias("date"), x["title"].alias("title"),
            theme(x["title"]).alias("theme"), regime(x["title"], x["head"]).alias("regime"), kind(file, x["number"], x["title"]).alias("kind"),
            F.when(repealed, "repealed").otherwise("in_force").alias("status"), measures(text).alias("measures"),
            F.array_distinct(F.regexp_extract_all(x["head"], F.lit(r"DCIS\s*(\d{1,3})"), F.lit(1))).alias("amendedBy"),
            F.slice(F.array_distinct(F.transform(found, clean_ws)), 1, 8).alias("instruments"),
        )

    return let(let(F.struct(head.alias("head")), first), whole)


def listed_in(decision: Column) -> Column:
    """Whether subjects are read from a decision: an implementation in force."""
    return (decision["kind"] == "implementation") & (decision["status"] == "in_force")
