"""From raw records to subjects, on invented records."""

from datetime import date

from pyspark.sql import functions as F

from sievebook.functions import extract
from sievebook.operators import subjects

RAW = "file string, ord int, listNumber string, type string, name string, info string, reason string, dates string, notes string, page int"


def values(spark, build, given):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    return [r.x for r in rows.select("i", build(F.col("t")).alias("x")).orderBy("i").collect()]


def test_names_that_are_none(spark):
    bad = ["Precizare: x", "Modificare efectuată y", "Conform informației", "Data nașterii 1.1.1990", "https://a.md", "Rectificat", "not a name", "Exclusă din listă", "exclus", "Prim-ministru"]
    bad += ["Președinte al Consiliului interinstituțional", "ABC este abrevierea de la x", "Arme de foc și muniții", "Echipamente militare", "În cauza 123", "Bunuri la care se face referire", "se citește după cum urmează", "x modificare efectuată în baza y", "12 ab 34", None]
    good = ["Ion Popa", "Exclusiv SRL", "Bombelles Ana", "Notă SRL", "Жук Юрий", "Echipamentele SA"]
    assert values(spark, extract.is_bad_name, bad) == [True] * len(bad)
    assert values(spark, extract.is_bad_name, good) == [False] * len(good)


def test_type_by_signs(spark):
    given = [("vessel", "Nava", "IMO 123", "vessel"), ("vessel", "X", "IMO 1, născut la", "person"), ("vessel", "X Y", "", "person"), ("person", "Alfa LLC", "", "entity"), ("person", "X", "Adresa: y", "entity"), ("entity", "X", "Funcția: y", "person"), ("entity", "X", "General la y", "person"), ("entity", "General X", "", "entity"), (None, "X", None, "person")]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(given)], "i int, d string, n string, t string, want string")
    assert [r.x == r.want for r in rows.withColumn("x", extract.refine_type(F.col("d"), F.col("n"), F.col("t"))).orderBy("i").collect()] == [True] * len(given)


def test_subjects_and_rejections(spark):
    records = [
        ("f", 1, None, "person", "Ion Popa alias Jon 2", "Data nașterii: 1.2.1960 Locul nașterii: Bălți Sexul: M Cetățenia: rusă, Republica Moldova. Funcția: deputat", "RM - 3.4.2024 UE - 1.1.2024 motiv", "", " n ", None),
        ("f", 2, "7", "person", "Ana Rus 2", "12.5.1971, Pașaport AB 1234567, IDNP 2001234567890", "UE – 2.2.2023 " + "x" * 220 + " RM: 9.9.2023", None, None, 4),
        ("f", 3, "8", "vessel", "Precizare necesară", "", "", "", "", 4),
        ("f", 4, "9", "entity", "Firma SRL", "", "născut la data de 3.3.1980 este titular", "UE - 5.5.2022", "", 5),
        ("f", 5, "10", "person", "Y", "", "", "", "", 5),
        ("g", 1, "1", "entity", "Beta LLC", "număr de identificare fiscal 2001234567890", "", "RM — 1.1.2024", "", 1),
        ("h", 1, "1", "person", "Not Read", "", "", "", "", 1),
        ("i", 1, "1", "person", "Nor This", "", "", "", "", 1),
    ]
    decisions = spark.createDataFrame([("f", "12", "implementation", "UE", "in_force"), ("g", "13", "implementation", "UK", "in_force"), ("h", "14", "implementation", "UK", "repealed"), ("i", "15", "amendment", "UK", "in_force")], "file string, id string, kind string, regime string, status string")
    kept, details, rejected = subjects.build_subjects(spark.createDataFrame(records, RAW), decisions)
    s, d = {r.id: r for r in kept.collect()}, {r.id: r for r in details.collect()}
    assert set(s) == set(d) == {"12-1", "12-2", "12-4", "13-1"}
    a, b, c, e = (s[x] for x in ("12-1", "12-2", "12-4", "13-1"))
    assert (a.name, a.aliases, a.listNumber, a.birthDate, a.citizenship, a.idnp, a.moldova, a.page, a.active) == ("Ion Popa", ["Jon 2"], "1", date(1960, 2, 1), ["rusă", "Republica Moldova"], None, True, 1, True)
    assert (a.listing.md, a.listing.foreign, d["12-1"].reason, d["12-1"].function, d["12-1"].birthPlace, d["12-1"].gender, d["12-1"].notes) == (date(2024, 4, 3), date(2024, 1, 1), "motiv", "deputat", "Bălți", "M", "n")
    assert (b.name, b.idnp, b.birthDate, b.moldova, [(x.kind, x.series, x.number) for x in b.documents]) == ("Ana Rus", "2001234567890", date(1971, 5, 12), True, [("pasaport", "AB", "1234567")])
    assert (b.listing.md, b.listing.foreign) == (date(2023, 9, 9), date(2023, 2, 2))
    assert (c.type, c.birthDate, c.listing.foreign, c.moldova) == ("entity", date(1980, 3, 3), date(2022, 5, 5), False)
    assert (e.type, e.idnp, e.active, e.listing.md) == ("entity", None, True, date(2024, 1, 1))
    assert {(r.file, r.ord, r.warning) for r in rejected.collect()} == {("f", 3, "nume_respins_3"), ("f", 5, "nume_respins_5")}
    report = spark.createDataFrame([("f", "table", 5, ["w"]), ("g", "table", 1, [])], "file string, method string, subjects long, warnings array<string>")
    out = {r.file: (r.subjects, r.warnings) for r in subjects.with_rejected(report, rejected).collect()}
    assert out == {"f": (3, ["w", "nume_respins_3", "nume_respins_5"]), "g": (1, [])}
