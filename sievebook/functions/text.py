"""Text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# How Cyrillic letters are written in Latin ones.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e",
    "ж": "j", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ц": "t", "ч": "c", "ш": "s", "щ": "s", "ъ": "",
    "ы": "i", "ь": "", "э": "e", "ю": "iu", "я": "ia", "і": "i", "ї": "i",
    "є": "e", "ґ": "g",
}
# Spellings taken for the same sound, in this order.
SOUNDS = [("sch", "s"), ("sh", "s"), ("ch", "c"), ("kh", "h"), ("ks", "x"), ("ts", "t"), ("y", "i"), ("ii", "i")]
# What a folded text keeps, letter by letter: Java looks these up at once, where it tries ranges one after the other.
KEPT = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Blocks whose letters are decomposed by a generated table.
BLOCKS = [(0xA0, 0x24F), (0x1E00, 0x1EFF), (0x2070, 0x209C), (0x2160, 0x217F), (0x2460, 0x24E9), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)]


@lru_cache
def decompositions(compatible: bool) -> tuple[str, str, list[tuple[str, str]]]:
    """(letters, their one-letter bases, [(letter, longer base)]) under NFKD or NFD without marks, lower case only."""
    one_from, one_to, longer = [], [], []
    for lo, hi in BLOCKS:
        for code in range(lo, hi + 1):
            c = chr(code)
            if c != c.lower():
                continue
            base = "".join(x for x in unicodedata.normalize("NFKD" if compatible else "NFD", c) if not unicodedata.combining(x))
            if base == c or not base:
                continue
            if len(base) == 1:
                one_from.append(c)
                one_to.append(base)
            else:
                longer.append((c, base))
    return "".join(one_from), "".join(one_to), longer


def fold(text: Column, variant: str = "build") -> Column:
    """Lower case, Latin, without marks, runs of anything but a-z and 0-9 as one blank (T-01, T-02). Null gives the empty text.

    ``build`` drops Cyrillic letters outside the table and decomposes
    compatibility characters; ``search`` turns both into blanks.
    """
    plain = F.lower(F.coalesce(text, F.lit("")))
    latin = let(plain, lambda p: F.when(_beyond_ascii(p), _latin(p, variant)).otherwise(p))
    return F.trim(F.regexp_replace(latin, f"[^{KEPT}]+", " "))


def _beyond_ascii(x: Column) -> Column:
    return F.octet_length(x) != F.length(x)


def _ranges(letters: str) -> str:
    """A pattern's class of these letters, runs as ranges: Java tries the members of a class one by one."""
    runs: list[list[str]] = []
    for c in sorted(letters):
        if runs and ord(c) == ord(runs[-1][1]) + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(lo if lo == hi else f"{lo}-{hi}" for lo, hi in runs)


def _latin(x: Column, variant: str) -> Column:
    """Lower-case text with its letters in Latin ones: first those that have one letter for theirs, then, if anything is left, the rare ones and marks.

    Patterns are tried character by character, so few are used, and only where a text needs them.
    """
    build = variant == "build"
    for letter, latin in CYRILLIC.items():
        if len(latin) == 2:
            x = F.replace(x, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in CYRILLIC.items() if len(v) == 1}
    gone = [k for k, v in CYRILLIC.items() if not v]
    if build:
        gone += [chr(c) for c in range(0x400, 0x500) if chr(c) not in CYRILLIC]
    letters, bases, longer = decompositions(build)
    x = F.translate(x, "".join(single) + letters + "".join(gone), "".join(single.values()) + bases)

    def rest(x: Column) -> Column:
        y = x
        if longer:
            found = F.array_distinct(F.regexp_extract_all(x, F.lit(f"([{_ranges(''.join(c for c, _ in longer))}])"), F.lit(1)))
            base = F.create_map(*(F.lit(s) for pair in longer for s in pair))
            y = F.aggregate(found, x, lambda y, c: F.replace(y, c, F.element_at(base, c)))
        return F.when(_beyond_ascii(x), F.regexp_replace(y, r"\p{Mn}" if build else r"\p{M}", "")).otherwise(x)

    return let(x, rest)


def canon(token: Column) -> Column:
    """Spellings of one sound made equal, then every doubled character halved (T-03)."""
    for old, new in SOUNDS:
        token = F.replace(token, F.lit(old), F.lit(new))
    return F.regexp_replace(token, r"(?s)(.)\1", "$1")


def words(text: Column) -> Column:
    """Array of the words of a folded text; of an empty one none."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Search tokens: folded words longer than one letter or with a digit, made canonical (T-04). No step of canon crosses a blank, so it is taken once for all words."""
    kept = F.filter(words(fold(text, "search")), lambda w: (F.length(w) > 1) | w.between("0", "9"))
    return words(canon(F.array_join(kept, " ")))


def canon_words(text: Column) -> Column:
    """All folded words, made canonical (T-05)."""
    return words(canon(fold(text)))


def clean_ws(text: Column) -> Column:
    """Soft hyphens and line-end hyphenation out, blanks collapsed (T-06)."""
    x = F.replace(text, F.lit("­"), F.lit(""))
    x = F.regexp_replace(x, r"(?U)(\w)-\s+(\w)", "$1$2")
    x = F.replace(F.replace(x, F.lit("~i"), F.lit("și")), F.lit("~I"), F.lit("Și"))
    return strip(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column, chars: str = r"\s") -> Column:
    return F.regexp_replace(text, rf"(?U)^[{chars}]+|[{chars}]+$", "")


def short(text: Column, limit: int = 160) -> Column:
    """Blanks collapsed; a longer text is cut at the last blank before the limit and marked with an ellipsis (T-07)."""
    x = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    head = F.regexp_replace(F.substring(x, 1, limit), "(?s) [^ ]*$", "")
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.regexp_replace(head, "[ ,;:]+$", ""), F.lit("…")))


def clean_role(text: Column) -> Column:
    """A function's text up to supplementary labels, without a leading label (T-08)."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    x = F.split(x, r"\s*(?:Alte informa[tțţ]ii|Informa[tțţ]ii suplimentare|Data na[sșş]terii|Locul na[sșş]terii)", 2)[0]
    x = F.regexp_replace(x, r"(?iuU)^\W*func[tțţ]ii\)?\s*:?\s*", "")
    return strip(F.regexp_replace(x, r"\s+", " "), " .;,:(")


def title_program(title: Column) -> Column:
    """A decision's title without its preamble, first letter capital (T-09)."""
    whole = F.coalesce(title, F.lit(""))
    x = F.regexp_replace(whole, r"(?iu)^privind\s+", "")
    x = F.regexp_replace(x, r"(?iuU)^punerea în aplicare a măsurilor restrictive internaționale(?:\s+ale\s+[^.]{0,90}?)?(?=\s+(?:având|împotriva|îndreptate|privind|pentru|în raport|instituite)\b)", "")
    x = strip(F.regexp_replace(x, r"(?U)\s+", " "))
    x = F.when(x == "", whole).otherwise(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))


def drop_footnote(name: Column) -> Column:
    """A parenthesis left open or closing nothing at the end and a trailing mark ' 1' or ' 1*' out; other numbers belong to the name (T-12)."""

    def unpaired(x: Column, last: str, other: str) -> Column:
        count = lambda c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
        return F.when(x.endswith(last) & (count(last) > count(other)), F.regexp_replace(x, r".[\s,;]*$", "")).otherwise(x)

    x = let(strip(name, " ,;"), lambda x: F.regexp_replace(unpaired(x, "(", ")"), "[ ,;]+$", ""))
    x = let(x, lambda x: F.regexp_replace(unpaired(x, ")", "("), "[ ,;]+$", ""))
    return strip(F.regexp_replace(x, r"(?U)\s+1\*?$", ""), " ,;")


# Runs of Cyrillic letters, and of those of Arabic.
_ARABIC = "\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF"
SCRIPT_RUN = rf"(?U)([\u0400-\u04FF][\u0400-\u04FF\s\-]{{2,80}}|[{_ARABIC}][{_ARABIC}\s\-]{{1,80}})"


def peel_scripts(text: Column) -> tuple[Column, Column]:
    """(the text without them, its runs of Cyrillic and Arabic letters in order) (T-15)."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(SCRIPT_RUN), F.lit(1)), clean_ws)
    return clean_ws(F.regexp_replace(text, SCRIPT_RUN, " ")), F.filter(runs, lambda r: r != "")


def highlight(text: Column, query: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Words that hold a query token between marks (T-17)."""
    parts = F.split(text, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")
    hit = lambda p: F.exists(tokens(p), lambda t: F.exists(query, lambda q: F.contains(t, q)))
    return F.array_join(F.transform(parts, lambda p: F.when(hit(p), F.concat(F.lit(before), p, F.lit(after))).otherwise(p)), "")


def escape_html(text: Column) -> Column:
    """T-18."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the characters' codes, eight hexadecimal capitals (T-20)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda s, c: F.pmod(s.bitwiseXOR(c) * F.lit(16777619).cast("long"), F.lit(1 << 32)))
    return F.lpad(F.hex(h), 8, "0")
