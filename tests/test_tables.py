"""From placed words to records and subjects, on invented files."""

from sievebook import schemas
from sievebook.operators import tables

X = {"name": 40.0, "info": 200.0, "motive": 330.0, "date": 470.0}
HEAD = {"name": "Numele", "info": "Informații", "motive": "Motivele", "date": "Data"}


def page(file, number, lines, width=600.0):
    """Words of lines: a line is a text over the whole width, or texts of columns; a wide text has a word every 90."""
    out = []
    for row, line in enumerate(lines):
        y = 50.0 + 14 * row
        if isinstance(line, str):
            placed = [(60.0 + 90 * i, w) for i, w in enumerate(line.split())]
        else:
            placed = [(X[c] + 8 * len(" ".join(t.split()[:i])) / 2, w) for c, t in line.items() for i, w in enumerate(t.split())]
        out += [(file, number, width, 800.0, len(out) + i, x, y + i % 2, x + 4.0 * len(w), y + 9, w) for i, (x, w) in enumerate(placed)]
    return out


def entry(number, name, info="Funcția: x", motive="motiv", date="UE - 1.1.2024"):
    return {"name": f"{number} {name}", "info": info, "motive": motive, "date": date}


FIRST = [
    "A. Entități juridice", HEAD, {"name": "1", "info": "2", "motive": "3", "date": "4"}, entry("1.", "Alfa SRL"), {"name": "Nord 1*", "info": "Adresa: y", "motive": "și alt", "date": "RM: 2.2.2024"},
    entry("2.", "Beta SRL Sexul: M"), {"name": "1"}, "1 Precizare necesară la acest rând anume", "Un text fără rost pe rândul lat", entry("3.(*)", "", "", "Modificare efectuată azi", ""),
    "B. Persoane fizice", {"name": "Fără", "info": "record"}, entry("1.", "Ion Popa"),
]
SECOND = ["ANEXĂ", {"name": "-Vasile"}, entry("2.", "Precizare", "", "veche", ""), "12", entry("29.(*)", "Ana Rus")]


def test_table(spark):
    words = page("a", 1, FIRST) + page("a", 2, SECOND) + page("b", 1, ["nimic"]) + page("c", 1, [{"name": "Nume", "motive": "Motiv"}, entry("1.", "Pierdut")]) + page("d", 1, [HEAD])
    given = spark.createDataFrame(words, schemas.WORD)
    records, warnings = tables.extract_table(given)
    got = [(r.file, r.ord, r.listNumber, r.type, r.name, r.info, r.reason, r.dates, r.notes, r.page) for r in records.orderBy("file", "ord").collect()]
    dates = "UE - 1.1.2024"
    assert got == [
        ("a", 1, "1", "entity", "Alfa SRL Nord", "Funcția: x Adresa: y", "motiv și alt", dates + " RM: 2.2.2024", "", 1),
        ("a", 2, "2", "entity", "Beta SRL", "Sexul: M Funcția: x", "motiv", dates, "1 Precizare necesară la acest rând anume Modificare efectuată azi", 1),
        ("a", 3, "1", "person", "Ion Popa -Vasile", "Funcția: x", "motiv", dates, "Precizare veche", 1),
        ("a", 4, "29", "person", "Ana Rus", "Funcția: x", "motiv", dates, "", 2),
    ]
    assert {r.file: r.warnings for r in warnings.collect()} == {"a": [], "c": ["coloane_nesigure_pagina_1", "tabel_fara_randuri"], "d": ["tabel_fara_randuri"]}
    records, warnings = tables.extract_table(given.limit(0))
    assert (records.count(), warnings.count()) == (0, 0)


def test_edges(spark):
    lines = [HEAD, *({"name": f"{i}. Nume", "info": "x", "motive": "y"} for i in range(1, 5))]
    words = [(*w[:5], w[5] + (12 if w[9] in HEAD.values() else 0), *w[6:]) for w in page("a", 1, lines)]
    rows = tables.page_rows(spark.createDataFrame(words, schemas.WORD))
    # No cell stands under the date, so its edge is left of its word.
    assert tables.header_edges(rows).first().edges == [40.0, 200.0, 330.0, 470.0 + 12 - 28]


def test_registry(spark):
    words = spark.createDataFrame(page("a", 1, FIRST) + page("a", 2, SECOND) + page("d", 1, [HEAD]) + page("e", 1, FIRST), schemas.WORD)
    told = "LISTA\n1. Maria Dan, născută la 1.2.1960\n2. Precizare x"
    files = spark.createDataFrame([("a", "LISTA", False), ("d", told, False), ("e", told, False), ("s", told, True), ("n", None, False)], "file string, text string, ocr boolean")
    decided = [("a", "1", "implementation", "in_force"), ("d", "2", "implementation", "in_force"), ("e", "3", "report", "in_force"), ("s", "4", "implementation", "in_force"), ("n", "5", "implementation", "in_force")]
    decisions = spark.createDataFrame([(f, i, k, "UE", s) for f, i, k, s in decided], "file string, id string, kind string, regime string, status string")
    found, details, report = tables.registry(words, files, decisions)
    assert sorted((r.id, r.name, r.type) for r in found.collect()) == [
        ("1-1", "Alfa SRL Nord", "person"), ("1-2", "Beta SRL", "person"), ("1-3", "Ion Popa -Vasile", "person"), ("1-4", "Ana Rus", "person"), ("2-1", "Maria Dan", "person"), ("4-1", "Maria Dan", "person"),
    ]
    assert details.count() == 6
    assert {r.file: (r.method, r.subjects, r.warnings) for r in report.collect()} == {
        "a": ("table", 4, []), "d": ("narrative", 1, ["tabel_fara_randuri", "nume_respins_2"]),
        "s": ("ocr_narrative", 1, ["ocr", "nume_respins_2"]), "n": ("table_empty", 0, ["fara_lista"]),
    }
