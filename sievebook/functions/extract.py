"""Field extraction as Column expressions; Arrow functions where a match's place is needed."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .dates import parse_numeric_date
from .text import CYRILLIC, clean_ws, fold, let, strip

# Weights of public functions, the highest that fits counts.
ROLE_WEIGHTS = [
    (30, r"prim.ministru|\bministru\b|ministrul|guvernator|bascan|deputat|senator|\bduma\b|sef(?:ul)? statului"
         r"|presedinte(?:le)? (?:al )?(?:republicii|statului|partidului|consiliului)|oligarh"),
    (20, r"\bgeneral\b|comandant|director general|procuror|judecator|vicepresedinte|viceprim|adjunct al ministrului"
         r"|\blider|presedinte"),
    (10, r"om de afaceri|director|politician|membru|sef\b|coordonat"),
]


# What opens a name that is none, and rows of annexes of goods.
BAD_STARTS = "^(?:precizare|modificare efectuata|conform informatiei|data nasterii|http|rectific|not |exclusa|presedinte al consiliului interinstitutional)"
NOT_A_SUBJECT = (
    r"\beste abrevierea\b|^plasa de sarma|^arme de foc|^cutite militare|^alti explozivi|^simulatoare\b|^echipamente\b|^bombe\b|^vehicule\b"
    r"|^substante explozive|\bnota generala\b|^in cauza \d+|dupa cum urmeaza|la care (?:nu )?se face referire"
)
# Signs of persons and of entities in folded text.
BIRTH_SIGNS = r"data nasterii|sexul|\bgenul\b|nascut|cetateni|\bfunctia\b|\bfunctie\b|^(?:colonel|locotenent|maior|general|capitan)"
ENTITY_SIGNS = (
    r"tip(?:ul)? de entitate|numar(?:ul)? de inregistrare|locul inregistrarii|data inregistrarii|data crearii|\bsediu\b|\badresa\b|site web|\btelefon\b"
)
CORPORATE = (
    "llc|jsc|ojsc|pjsc|cjsc|ltd|limited|inc|company|corporation|group|institute|industries|plant|association|society|force|partidul|serviciul"
    "|enterprise|bank|pmc|sc|fze|fzco|dmcc|gmbh|co"
)


def field_after(text: Column, labels: str, stops: str, most: int = 400) -> Column:
    """Cleaned text after a label up to a stop word or the end; empty without one (F-01)."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?ius)(?:{labels})(?![a-zăâîșț])\s*[:\-]?\s*(.+?)(?:{stops}|$)", 1)
    return F.substring(clean_ws(found), 1, most)


def parse_idnp(text: Column) -> Column:
    """The first 13-digit number after its label; labels other than that of the number itself need a number of the known forms (F-02)."""
    # Labels of the number.
    pattern = r"(?iu)(IDNP|identificare de stat|număr(?:ul)? de identificare(?!\s+fiscal)(?:\s+de stat)?|numar national de identificare)[^0-9]{0,40}(\d{13})"
    labels, numbers = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(i)) for i in (1, 2))
    pairs = F.filter(F.arrays_zip(labels.alias("label"), numbers.alias("number")), lambda p: (F.lower(p["label"]) == "idnp") | p["number"].rlike(r"^(09|20)\d{11}$"))
    return F.get(pairs, F.lit(0))["number"]


def digit_runs(text: Column, digits: int = 13) -> Column:
    """All whole runs of so many digits."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?<!\d)(\d{{{digits}}})(?!\d)"), F.lit(1))


_DOCUMENT = ArrayType(StructType([StructField(x, StringType()) for x in ("kind", "series", "number", "raw")]))


def _plain(text: str) -> str:
    """Lower case in Latin letters without marks, to find the kinds of documents."""
    latin = "".join(CYRILLIC.get(c, c) for c in text.lower())
    return "".join(c for c in unicodedata.normalize("NFKD", latin) if not unicodedata.combining(c))


def _clean(text: str) -> str:
    """text.clean_ws on a string."""
    x = re.sub(r"(\w)-\s+(\w)", r"\1\2", text.replace("\u00ad", "")).replace("~i", "și").replace("~I", "Și")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", x)).strip()


@F.pandas_udf(_DOCUMENT)
def parse_documents(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Identity documents in a text, given the personal number that is none (F-03)."""
    keyed = re.compile(r"(buletin\w*|pa[sș]aport\w*|permis\w*)(.{0,80}?)(?:seria\s+)?([A-Z]{1,3})?\s*(?:nr\.?\s*)?(\d[\d\s]{4,12})", re.I)
    bare = re.compile(r"\b([A-Z]{1,2})\s+(?:nr\.?\s*)?(\d{6,9})\b")

    def kind_of(text: str, kinds: tuple[str, ...], other: str) -> str:
        return next((k for k in kinds if k in _plain(text)), other)

    def one(text: str | None, number: str | None) -> list[dict]:
        text, out, seen = text or "", [], set()

        def add(kind: str, series: str, digits: str, raw: str) -> None:
            series, digits = re.sub("[^A-Za-z]", "", series).upper(), re.sub(r"\D", "", digits)
            if 5 <= len(digits) <= 10 and digits != number and (series, digits) not in seen:
                seen.add((series, digits))
                out.append({"kind": kind, "series": series, "number": digits, "raw": _clean(raw)[:180]})

        for m in keyed.finditer(text):
            add(kind_of(m[1], ("buletin", "permis"), "pasaport"), m[3] or "", m[4], m[0])
        for m in bare.finditer(text):
            add(kind_of(text[max(0, m.start() - 60) : m.start()], ("buletin", "pasaport", "permis"), "act"), m[1], m[2], m[0])
        return out

    for texts, numbers in parts:
        yield pd.Series([one(t, n) for t, n in zip(texts, numbers)])


def parse_listing(text: Column) -> Column:
    """Last valid local and last valid foreign listing date of LABEL - date pairs, and the text (F-04)."""
    pattern = r"(?u)\b(RM|UE|UK|SUA|US|CA|ONU)\b\s*[-–—:]\s*(\d{1,2}[./]\d{1,2}[./]\d{2,4})"
    labels, dates = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(i)) for i in (1, 2))
    pairs = F.transform(F.arrays_zip(labels.alias("label"), dates.alias("date")), lambda p: F.struct(p["label"].alias("label"), parse_numeric_date(p["date"]).alias("date")))
    last = lambda keep: F.try_element_at(F.filter(pairs, lambda p: p["date"].isNotNull() & keep(p["label"])), F.lit(-1))["date"]
    return F.struct(last(lambda x: x != "RM").alias("foreign"), last(lambda x: x == "RM").alias("md"), F.substring(clean_ws(F.coalesce(text, F.lit(""))), 1, 240).alias("raw"))


def citizenship(field: Column) -> Column:
    """F-09."""
    parts = F.transform(F.split(field, r"(?U),|/|\s+și\s+"), lambda p: strip(p, " .;"))
    return F.filter(parts, lambda p: (p != "") & (F.length(p) < 80))


def role_weight(function: Column) -> Column:
    """F-17."""
    folded, out = fold(function), F.lit(0)
    for weight, pattern in reversed(ROLE_WEIGHTS):
        out = F.when(folded.rlike(pattern), weight).otherwise(out)
    return out


def is_bad_name(name: Column) -> Column:
    """Names that are none: too short, only digits, notes, labels, rows of goods annexes, titles, or without three letters in a row (F-20)."""

    def bad(f: Column) -> Column:
        none = (F.length(f) < 3) | f.rlike("^[0-9]+$") | f.rlike(BAD_STARTS) | f.contains("modificare efectuata in baza")
        return none | f.rlike(NOT_A_SUBJECT) | (f == "prim ministru") | (f == "exclus") | ~f.rlike("[a-z]{3}")

    return let(name, lambda n: let(fold(n), bad))


def refine_type(declared: Column, name: Column, info: Column) -> Column:
    """vessel, person or entity by the signs in name and info, which count more than the section's type (F-11)."""

    def of(f: Column) -> Column:
        birth, imo = F.concat_ws(" ", f["info"], F.lit(""), f["both"]).rlike(BIRTH_SIGNS), f["both"].rlike(r"\bimo\b")
        entity = f["both"].rlike(ENTITY_SIGNS) | f["name"].rlike(rf"\b(?:{CORPORATE})\b")
        given = F.when(declared == "vessel", "person").when(declared != "", declared).otherwise("person")
        return F.when(imo & ~birth, "vessel").when(birth, "person").when(entity, "entity").otherwise(given)

    def folded(s: Column) -> Column:
        return let(F.struct(fold(s["name"]).alias("name"), fold(s["info"]).alias("info"), fold(F.concat_ws(" ", s["name"], s["info"])).alias("both")), of)

    return let(F.struct(F.coalesce(name, F.lit("")).alias("name"), F.coalesce(info, F.lit("")).alias("info")), folded)


def clean_reason(reason: Column) -> Column:
    """The reason without runs of listing dates written without colon (F-06)."""
    dates = r"(?U)(?:\b(?:UE|UK|RM|SUA|US|CA|ONU)\s*[-–—]\s*\d{1,2}[./]\d{1,2}[./]\d{2,4}\s*)+"
    return clean_ws(F.regexp_replace(F.coalesce(reason, F.lit("")), dates, " "))


def page_of(text: Column, snippet: Column) -> Column:
    """1 and the form feeds before the snippet's first 24 characters; 1 if they are absent (F-19)."""
    at = F.call_function("locate", F.substring(snippet, 1, 24), text)
    before = F.substr(text, F.lit(1), F.greatest(at - 1, F.lit(0)))
    return F.lit(1) + F.length(before) - F.length(F.replace(before, F.lit("\f"), F.lit("")))
