"""Decisions, names in lists, running text and the gate, on invented records."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sievebook.functions import decisions, names, rows, text
from sievebook.operators import gate, layout, narrative


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


HEAD = (
    "DECIZIE nr. 7 din 3 mai 2023 Privind punerea în aplicare a măsurilor restrictive internaționale ale Uniunii Europene împotriva unora "
    "MODIFICAT DCIS 9, DCIS 9, DCIS 12\nÎn conformitate cu Decizia (PESC) 2023/891 blocarea fondurilor și interzice intrarea"
)


def test_classify(spark):
    d = one(spark, decisions.classify(F.lit("/a/Decizie nr. 99.pdf"), F.lit(HEAD)))
    assert (d.id, d.number, d.date, d.theme, d.regime, d.kind, d.status) == ("7", 7, date(2023, 5, 3), "impotriva unora", "UE", "implementation", "in_force")
    assert (d.measures, d.amendedBy, d.instruments) == (["asset_freeze", "travel_ban"], ["9", "12"], ["Decizia (PESC) 2023/891"])
    d = one(spark, decisions.classify(F.lit("Raport.pdf"), F.lit(None).cast("string")))
    assert (d.id, d.number, d.kind, d.title, d.measures) == ("Raport", None, "report", "Raport", [])
    kinds = [(18, "altele", "amendment"), (18, "Punerea x", "implementation"), (23, "x", "alignment"), (1, "Aliniere la", "alignment"), (1, "Modificarea", "amendment"), (None, "x", "implementation")]
    assert [one(spark, decisions.kind(F.lit("f"), F.lit(n).cast("int"), F.lit(t))) for n, t, _ in kinds] == [k for *_, k in kinds]
    said = [("Regatului Unit și Uniunii Europene", "UK"), ("Statelor Unite", "SUA"), ("Canadei", "Canada"), ("rezoluția ONU", "ONU"), ("PESC", "UE"), ("bonus", "Altele")]
    assert [one(spark, decisions.regime(F.lit(t), F.lit(""))) for t, _ in said] == [r for _, r in said]
    assert one(spark, decisions.theme(F.lit(" "))) == "nedeterminat"


def test_names(spark):
    given = [("Abc (", "Abc"), ("Abc )", "Abc"), ("Tzav 9", "Tzav 9"), ("Abc 1*", "Abc"), ("Abc (x)", "Abc (x)"), ("Abc 1", "Abc"), (" ;Abc,", "Abc")]
    assert [one(spark, text.drop_footnote(F.lit(x))) for x, _ in given] == [y for _, y in given]
    tidy = lambda n, t: tuple(one(spark, names.tidy_name(F.lit(n), F.lit(t))))
    assert tidy("12. Ion Popa Precizare necesară: x", "n") == ("Ion Popa", "Precizare necesară: x n")
    assert tidy("Ion crt.", "") == ("Ion", "") and tidy("Inclus pe listă", "") == ("Inclus pe listă", "")
    detach = lambda n: tuple(one(spark, names.detach_labels(F.lit(n), F.lit("i"))))
    assert [detach(x) for x in ("Ion Popa Funcția: șef", "Sexul: M", "Ion")] == [("Ion Popa", "Funcția: șef i"), ("", "Sexul: M i"), ("Ion", "i")]
    split = lambda n: tuple(one(spark, names.split_aliases(F.lit(n).cast("string"))))
    assert split("Ion Popa (engleză: John Pope) alias Jon Popa; ion popa; Johnny aka Иван Patronimic: Vasile") == ("Ion Popa", ["Jon Popa", "Johnny", "Vasile", "John Pope", "Иван"])
    assert split(None) == ("", []) and split("Ana Rus") == ("Ana Rus", []) and split("Ana «Анна» Rus")[1] == ["Анна"]


def test_row_predicates(spark):
    titles = [("A. Persoane fizice", "person"), ("II. Entități juridice", "entity"), ("b. nave maritime", "vessel"), ("A. Data nașterii persoanei", None), ("Persoane", None), ("a. x", None), (None, None)]
    assert [one(spark, rows.section_type(F.lit(t).cast("string"))) for t, _ in titles] == [k for _, k in titles]
    assert [one(spark, rows.is_junk_line(F.lit(t))) for t in ("ANEXĂ", "1234", "Lista x", "12345")] == [True, True, False, False]
    assert [one(spark, rows.is_column_index_row(F.array(*map(F.lit, c)))) for c in (["1", "2"], ["1", ""], ["", ""], ["1", "a"])] == [True, True, False, False]
    numbers = [("29.(*) Ion", ("29", "Ion")), ("7 Ion", ("7", "Ion")), ("0. x", None), ("5001. x", None), ("7.Ion", None)]
    assert [one(spark, rows.leading_number(F.lit(t))) for t, _ in numbers] == [n for _, n in numbers]
    assert tuple(one(spark, rows.narrative_fields(F.lit("Ion Popa 2, născut la 1.2.1960 Alte informații: motiv")))) == ("Ion Popa", "la 1.2.1960", "Alte informații: motiv")
    assert tuple(one(spark, rows.narrative_fields(F.lit("x" * 130)))) == ("x" * 120, "x" * 130, "")


LISTED = "Anexă\n\fLISTA\nA. Persoane fizice\n1. Ion Popa, născut la 1.2.1960 în sat\n2021. În această calitate\n2. Ana Rus IDNP 5\n3 Precizare necesară: da\nB. Entități juridice\n1. Firma Sexul: x\n"


def test_narrative(spark):
    files = spark.createDataFrame([("a", LISTED, False), ("b", None, False), ("c", "LISTA\n[…]", False), ("d", "LISTA fără", True), ("e", LISTED, False)], "file string, text string, ocr boolean")
    got = narrative.extract_narrative(files.where("file <> 'e'")).orderBy("ord").collect()
    assert [(r.file, r.listNumber, r.type, r.name, r.notes, r.page) for r in got] == [
        ("a", "1", "person", "Ion Popa", "", 2), ("a", "2", "person", "Ana Rus", "Precizare necesară: da", 2), ("a", "1", "entity", "Firma", "", 2),
    ]
    assert got[0].info == "la 1.2.1960 în sat 2021. În această calitate"
    found = narrative.extract_narrative(files)
    used, report = narrative.choose(files, found.where("file = 'e' and ord = 1"), found)
    assert {r.file: (r.method, r.subjects, r.warnings) for r in report.collect()} == {
        "a": ("narrative", 3, []), "b": ("table_empty", 0, ["fara_lista"]), "c": ("table_empty", 0, ["anexa_goala"]),
        "d": ("skipped", 0, ["ocr", "ocr_gol", "narativ_fara_intrari", "fara_subiecti"]), "e": ("table", 1, []),
    }
    assert sorted((r.file, r.method) for r in used.collect()) == [("a", "narrative")] * 3 + [("e", "table")]
    assert narrative.extract_narrative(files.limit(0)).count() == 0


def test_layout_rules(spark):
    words = [("f", 1, r, o, x, x + 20.0, t) for r in range(4) for o, (x, t) in enumerate([(10.0, "Ion"), (80.0, "Funcția:"), (300.0, "sexul")])]
    placed = spark.createDataFrame(words, "file string, page int, row int, ord int, x0 double, x1 double, text string")
    edges = spark.createDataFrame([("f", 1, [10.0, 150.0, 290.0]), ("g", 1, [1.0, 2.0, 3.0])], "file string, page int, edges array<double>")
    assert {r.file: r.edges for r in layout.snap_info_edge(placed, edges).collect()} == {"f": [10.0, 76.0, 290.0], "g": [1.0, 2.0, 3.0]}
    wide = spark.createDataFrame([("f", 1, r, 30.0 + 90 * i, 100.0 + 90 * i) for r, n in ((0, 6), (1, 5)) for i in range(n)], "file string, page int, row int, x0 double, x1 double")
    page = spark.createDataFrame([("f", 1, 600.0, [30.0, 170.0])], "file string, page int, width double, edges array<double>")
    assert [r.row for r in layout.footnote_rows(wide, page).collect()] == [0]
    lines = spark.createDataFrame([("f", p, r, "12" if r == 1 else f"x{p}{r}", p in (1, 3) and r == 2) for p in (1, 2, 3) for r in range(5)], "file string, page int, row int, text string, header boolean")
    got = layout.body_sample(lines, most=5)
    assert [(r.header_page, r.text) for r in got.orderBy("page", "row").collect()] == [(1, "x13"), (1, "x14"), (1, "x20"), (1, "x22"), (1, "x23"), (3, "x33"), (3, "x34")]


def test_gate(spark):
    doc = "array<struct<kind:string,series:string,number:string,raw:string>>"
    records = spark.createDataFrame([("1", "a", "long reason", [("act", "", "55", "")]), ("2", "b", None, None)], f"idnp string, decisionId string, reason string, documents {doc}")
    wanted = spark.createDataFrame([("1", "a", 5, "55"), ("1", "x", None, None), ("2", "b", 3, "7"), ("3", None, None, None), ("2", None, None, None)], gate.EXPECTATION)
    assert sorted(map(tuple, gate.problems(records, wanted).collect())) == [("1", "decision"), ("2", "document"), ("2", "reason"), ("3", "missing")]
    with pytest.raises(gate.ValidationError):
        gate.require(records, wanted)
    gate.require(records, wanted.where("document = '55'"))
