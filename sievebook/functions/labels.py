"""Labels and formats of what is shown as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of types, measures, documents and kinds of decisions, short names of months.
TYPES = {"person": "Persoană", "entity": "Entitate", "vessel": "Navă"}
MEASURES = {"asset_freeze": "Blocarea fondurilor și a resurselor economice", "travel_ban": "Restricții de călătorie"}
DOCUMENTS = {"buletin": "Buletin", "pasaport": "Pașaport", "permis": "Permis"}
KINDS = {"implementation": "Punere în aplicare", "amendment": "Modificare", "alignment": "Aliniere", "report": "Raport"}
MONTHS = ["ian.", "feb.", "mar.", "apr.", "mai", "iun.", "iul.", "aug.", "sep.", "oct.", "nov.", "dec."]


def labelled(value: Column, labels: dict[str, str], other: Column | None = None) -> Column:
    """The label of a value; of one without, the value itself or ``other``."""
    out = value if other is None else other
    for key, label in labels.items():
        out = F.when(value == key, F.lit(label)).otherwise(out)
    return out


def day(date: Column) -> Column:
    """dd.MM.yyyy; empty for null."""
    return F.coalesce(F.date_format(date, "dd.MM.yyyy"), F.lit(""))


def month(bucket: Column) -> Column:
    """'2024-03' as a short name and year."""
    return F.concat_ws(" ", F.get(F.array(*map(F.lit, MONTHS)), F.substring(bucket, 6, 2).cast("int") - 1), F.substring(bucket, 1, 4))


def number(value: Column) -> Column:
    """Thousands parted by points."""
    return F.translate(F.format_number(F.coalesce(value, F.lit(0)), 0), ",", ".")


def counted(value: Column, one: str, many: str) -> Column:
    """A number with its noun; from 20 on 'de' stands before the noun, unless the last two digits are 1 to 19."""
    rest = value % 100
    with_de = (value >= 20) & ((rest == 0) | (rest >= 20))
    return F.when(value == 1, F.concat(number(value), F.lit(f" {one}"))).otherwise(F.concat(number(value), F.when(with_de, " de ").otherwise(" "), F.lit(many)))


def decision(number_: Column, date: Column) -> Column:
    return F.concat(F.lit("Decizia CIS nr. "), F.coalesce(number_.cast("string"), F.lit("null")), F.when(date.isNotNull(), F.concat(F.lit(" din "), day(date))).otherwise(""))


def document(doc: Column) -> Column:
    """Kind, series if any, and number."""
    series = F.coalesce(doc["series"], F.lit(""))
    return F.concat(labelled(doc["kind"], DOCUMENTS, F.lit("Act")), F.lit(" "), F.when(series != "", F.concat(series, F.lit(" "))).otherwise(""), doc["number"])


def percent(score: Column) -> Column:
    """A share as a whole percentage (N-02)."""
    return F.round(score * 100).cast("int")


def bars(values: Column, most: Column, log: bool = False) -> Column:
    """Width of a bar in percent of the largest, at least 2; ``log`` scales by log10(value + 1) (O-18, N-04)."""
    scale = (lambda x: F.log10(x + 1)) if log else (lambda x: x.cast("double"))
    return F.greatest(F.lit(2.0), scale(values) / F.greatest(F.lit(1.0), scale(most)) * 100)


def heights(values: Column, most: Column) -> Column:
    """Height of a month's bar: square root of its share, at least 4, and 0 for none (O-18)."""
    return F.when(values > 0, F.greatest(F.lit(4.0), F.sqrt(values / most) * 100)).otherwise(0.0)
