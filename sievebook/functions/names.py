"""Names as they stand in lists as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_ws, drop_footnote, fold, let, peel_scripts, strip

# Where a note begins in a name.
NOTE_MARKERS = [
    "Precizare necesară", "Precizare necesara", "* Precizare", "Modificare efectuată", "Modificare efectuata", "figurează în Registrul",
    "figureaza in Registrul", "Conform informației", "Conform informatiei", "Conform informaţiei", "Inclus pe listă", "Inclusă pe listă",
]
# Labels of identification, words that part aliases, languages.
LABELS = (
    r"Func[tț]i[ae]|Cet[aă][tț]eni[ae]|Sexul|Sex|Grad|Titlu|Pozi[tț]ie|Adres[aă]|Locul(?:\s+na[sș]terii)?|Data(?:\s+na[sș]terii)?"
    r"|Num[aă]rul|Na[tț]ionalitate|Rus[aă]|Ucrainean[aă]"
)
ALIAS_WORDS = r"alias|a\.k\.a\.?|aka|cunoscut[ăa]?\s+și\s+sub\s+numele(?:\s+de)?|variante ale numelui(?:\s+principal)?|nume nelatine?"
LANGUAGES = r"rus[aă]|ucrainean[aă]|belarus[aă]|uzbec[aă]|arab[aă]|persan[aă]|englez[aă]|chinez[aă]"

_NAME = "struct<name:string,notes:string>"
_LABELLED = rf"\(\s*((?:{LANGUAGES})\s*:[^)]{{0,120}})\)?"


def _struct(**columns: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in columns.items()))


def tidy_name(name: Column, notes: Column) -> Column:
    """Struct of the name without leading signs, notes, stars and 'crt', and of the notes with those found in it (T-11)."""

    def part(s: Column, marker: Column) -> Column:
        at = F.call_function("locate", F.lower(marker), F.lower(s["name"]))
        moved = _struct(name=F.substr(s["name"], F.lit(1), at - 1), notes=clean_ws(F.concat_ws(" ", F.substr(s["name"], at), s["notes"])))
        return F.when(at > 3, moved).otherwise(s).cast(_NAME)

    start = F.regexp_replace(clean_ws(F.coalesce(name, F.lit(""))), r"^[^A-Za-zÀ-žЀ-ӿ]+", "")
    parted = F.aggregate(F.array(*map(F.lit, NOTE_MARKERS)), _struct(name=start, notes=F.coalesce(notes, F.lit(""))).cast(_NAME), part)

    def end(s: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(s["name"], r"[\s*]+$", ""), r"(?:[\s,]+crt\.?|\s+\.)$", "")
        return _struct(name=clean_ws(drop_footnote(x)), notes=clean_ws(s["notes"]))

    return let(parted, end)


def detach_labels(name: Column, info: Column) -> Column:
    """Struct of name and info; a label in the name and what follows it move to the info (T-13)."""
    inside = rf"(?iusU)^(.*?)(\s+(?:{LABELS})\s*:.*)$"
    before = F.regexp_extract(name, inside, 1)
    moved = _struct(name=clean_ws(before), info=clean_ws(F.concat_ws(" ", F.regexp_extract(name, inside, 2), info)))
    whole = _struct(name=F.lit(""), info=clean_ws(F.concat_ws(" ", name, info)))
    return F.when(F.length(before) >= 2, moved).when(name.rlike(rf"(?iuU)^(?:{LABELS})\s*:"), whole).otherwise(_struct(name=name, info=info))


def strip_script_labels(text: Column) -> tuple[Column, Column]:
    """(the text without '(language: form)', the forms with three Latin letters in a row) (T-16)."""
    inner = lambda g: clean_ws(strip(peel_scripts(F.regexp_replace(g, rf"(?iuU)^(?:{LANGUAGES})\s*:\s*", ""))[0], r"\s;,"))
    forms = F.transform(F.regexp_extract_all(text, F.lit("(?iuU)" + _LABELLED), F.lit(1)), inner)
    rest = F.regexp_replace(F.regexp_replace(text, "(?iuU)" + _LABELLED, " "), r"\(\s*\)", " ")
    return clean_ws(rest), F.filter(forms, lambda x: x.rlike("[A-Za-zÀ-ž]{3}"))


def _primary(text: Column) -> Column:
    """A main name without remarks on spelling, footnotes and stars."""
    x = F.regexp_replace(text, r"(?iuU)\s*\(ortografi[ae]\s+[^)\s]+\)", "")
    x = F.regexp_replace(x, r"(?iuU)\s*\((?:ortografi\w*|rus[aă]|ucrainean[aă]|belarus[aă])\b[^)]*\)?\s*$", "")
    return strip(F.regexp_replace(drop_footnote(x), r"\*+$", ""))


def split_aliases(name: Column) -> Column:
    """Struct of the main name and its aliases, each once by its folded form, without the main name's (T-14).

    In order: parts after alias words, quoted Cyrillic forms, the patronymic,
    then forms in other scripts or after a language. A null name is empty.
    """
    patronymic = r"(?iuU)\s+Patronimic:\s*(.+)$"

    def parts(s: Column) -> Column:
        bare = clean_ws(F.regexp_replace(s, patronymic, ""))
        pieces = F.filter(F.transform(F.split(bare, rf"(?iuU)\b(?:{ALIAS_WORDS})\b[:\s]*"), clean_ws), lambda p: p != "")
        return _struct(patronymic=clean_ws(F.regexp_extract(s, patronymic, 1)), parts=pieces)

    def forms(s: Column) -> Column:
        first = F.coalesce(F.get(s["parts"], F.lit(0)), F.lit(""))
        more = F.flatten(F.transform(F.slice(s["parts"], 2, F.greatest(F.size(s["parts"]), F.lit(1))), lambda p: F.split(p, r"(?U)\s*;\s*|\s+\(\d+\)\s+")))
        more = F.transform(more, lambda p: strip(p, " ;,"))
        more = let(fold(first), lambda f: F.filter(more, lambda p: (p != "") & (fold(p) != f)))
        quoted = F.filter(F.regexp_extract_all(first, F.lit("[«“\"]([^»”\"]{2,80})[»”\"]"), F.lit(1)), lambda q: q.rlike("[Ѐ-ӿ]"))
        extra = F.filter(F.array(s["patronymic"]), lambda p: p != "")
        latin, scripts = peel_scripts(first)
        plain, written = strip_script_labels(latin)
        return _struct(name=_primary(plain), aliases=F.concat(more, quoted, extra), scripts=F.concat(scripts, written), any=F.size(s["parts"]) > 0)

    def unique(s: Column) -> Column:
        latin = F.transform(s["aliases"], lambda a: drop_footnote(peel_scripts(a)[0]))
        found = F.concat(latin, s["scripts"], F.flatten(F.transform(s["aliases"], lambda a: peel_scripts(a)[1])))
        keyed = F.transform(F.filter(found, lambda a: a != ""), lambda a: let(fold(a), lambda f: _struct(key=F.when(f == "", a).otherwise(f), value=a)))

        def once(k: Column) -> Column:
            own = fold(s["name"])
            keys = F.transform(k, lambda x: x["key"])
            return let(_struct(own=own, keys=keys), lambda o: F.filter(k, lambda x, i: (x["key"] != o["own"]) & (F.array_position(o["keys"], x["key"]) == i + 1)))

        none = F.array().cast("array<string>")
        return _struct(name=s["name"], aliases=F.when(s["any"], F.transform(let(keyed, once), lambda x: x["value"])).otherwise(none))

    return let(let(let(clean_ws(F.coalesce(name, F.lit(""))), parts), forms), unique)
