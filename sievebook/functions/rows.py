"""Predicates of a list's rows and the parts of a narrative entry (F-18) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_ws, fold, let, strip

# Words of section titles and of rows that are none.
NOT_A_SECTION = "naster|funct|idnp|pasaport|buletin"
SECTIONS = [("vessel", "nave|vasel"), ("entity", "juridic|entit|organism|organiza"), ("person", "persoan|fizic")]
# What begins the reasons, the first that stands in a text counts.
REASON_MARKERS = ["Alte informații:", "Alte informatii:", "Expunerea de motive", "(Expunerea de motive"]
# What ends a name.
NAME_ENDS = (
    r",?\s+n[aă]scut[ăa]?|,?\s+IDNP\b|Data na[sș]terii\b|Func[tț]i|Pozi[tț]ie\b|Nume \(alfabet|\s+Cet[aă][tțţ]eni[ae]\s*:|\s+Gen(?:ul)?\s*:"
    r"|\s+Sex(?:ul)?\s*:|\s+Adres[aă]\s*:|\s+Locul na[sș]terii|\s+Alte (?:entit|informa)|\s+Locul [îi]nregistr[aă]rii|\s+Tip(?:ul)? de entitate"
)


def section_type(text: Column) -> Column:
    """vessel, entity or person of a section's title; null of another line."""

    def of(f: Column) -> Column:
        title = F.length(f).between(8, 140) & f.rlike(r"^(?:[a-z]|i{1,3}|iv)\b") & ~f.rlike(NOT_A_SECTION)
        return F.when(title, F.coalesce(*(F.when(f.rlike(words), name) for name, words in SECTIONS)))

    return let(fold(text), of)


def is_column_index_row(columns: Column) -> Column:
    """Rows whose filled columns are all numbers of one or two digits."""
    filled = F.filter(F.transform(columns, lambda c: fold(c)), lambda f: f != "")
    return let(filled, lambda x: (F.size(x) > 0) & F.forall(x, lambda f: f.rlike(r"^\d{1,2}$")))


def is_junk_line(text: Column) -> Column:
    """Headings of the list itself, and bare numbers."""
    return fold(text).rlike(r"^(?:anexa|lista|crt|\d{1,4})$")


def leading_number(text: Column) -> Column:
    """Struct of the number 1 to 5,000 that opens a row, as written, and the rest; null without one."""
    pattern = r"(?U)^\s*(\d{1,4})(?:\.?\s+|\.\s*\(\*\)\s*)(.*)$"
    number = F.regexp_extract(text, pattern, 1)
    return F.when(number.try_cast("int").between(1, 5000), F.struct(number.alias("number"), strip(F.regexp_extract(text, pattern, 2)).alias("rest")))


def narrative_fields(body: Column) -> Column:
    """Struct of name, info and reason of an entry (F-18).

    The name ends where a label begins; without one it is the first 120
    characters. A number of one or two digits at its end is a footnote's.
    """

    def cut(b: Column) -> Column:
        places = [F.call_function("locate", F.lit(m), b) for m in REASON_MARKERS]
        at = F.coalesce(*(F.when(p > 1, p) for p in places), F.length(b) + 1)
        return F.struct(strip(F.substr(b, F.lit(1), at - 1)).alias("info"), strip(F.substr(b, at)).alias("reason"))

    def parts(s: Column) -> Column:
        pattern = rf"(?iusU)^(.+?)(?:{NAME_ENDS})(.*)$"
        head, rest = F.regexp_extract(s["info"], pattern, 1), clean_ws(F.regexp_replace(F.regexp_extract(s["info"], pattern, 2), "^[ ,]+", ""))
        name = clean_ws(F.when(head == "", F.substring(s["info"], 1, 120)).otherwise(head))
        return F.struct(strip(F.regexp_replace(name, r"(?U)\s+\d{1,2}$", ""), " ,;").alias("name"), F.when(rest == "", s["info"]).otherwise(rest).alias("info"), s["reason"].alias("reason"))

    return let(let(F.coalesce(body, F.lit("")), cut), parts)
