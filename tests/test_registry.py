"""Rules of the registry on invented records."""

import unicodedata
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievebook import schemas
from sievebook.functions import dates, extract, text
from sievebook.functions.similarity import jaro_winkler, name_score
from sievebook.operators import fuzzy, layout, registry, search
from sievebook.sources import publish, read

AS_OF = "2025-06-30"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(spark, build, given):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    return [r.x for r in rows.select("i", build(F.col("t")).alias("x")).orderBy("i").collect()]


def fold_model(s, build):
    s = (s or "").lower()
    out = ""
    for c in s:
        if "Ѐ" <= c <= "ӿ":
            out += text.CYRILLIC.get(c, "" if build else c)
        else:
            out += c
    s = unicodedata.normalize("NFKD" if build else "NFD", out)
    s = "".join(c for c in s if not (unicodedata.combining(c) if build else unicodedata.category(c).startswith("M")))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s).split())


@pytest.mark.parametrize("variant", ["build", "search"])
def test_fold(spark, variant):
    given = [None, "", "Șor Ștefan-Ţurcanu ĂÂÎ", "Жук Юрий Яковлев съезд", "ўк аўб", "ﬁne ①² ½", "Éric Ñandú ÿ", "áb", "Ångström ŁÓDŹ ß", "1.234,56", "ǅ ĳ ŉ"]
    given += [chr(c) for lo, hi in text.BLOCKS for c in range(lo, hi + 1) if chr(c).isalpha() and len(chr(c).lower()) == 1 and chr(c).lower() == chr(c)]
    assert values(spark, lambda c: text.fold(c, variant), given) == [fold_model(s, variant == "build") for s in given]


def test_canon_and_tokens(spark):
    assert values(spark, text.canon, ["iii", "aaa", "shor", "schor", "khan", "yuriy", "aleksei", "tsar", "0992112", "anna"]) == ["i", "aa", "sor", "sor", "han", "iuri", "alexei", "tar", "09212", "ana"]
    assert values(spark, text.tokens, ["A b 7 Iurii", "!!", None]) == [["7", "iuri"], [], []]


def test_short_and_blanks(spark):
    assert values(spark, lambda c: text.short(c, 10), ["a  b", "abcdefg hij klm", "abcdefghijklm", None]) == ["a b", "abcdefg…", "abcdefghij…", ""]
    assert values(spark, text.clean_ws, ["in- terior­  x", "a\n\n\n\nb", "~i"]) == ["interior x", "a\n\nb", "și"]
    assert one(spark, text.fnv1a(F.lit("a"))) == "E40C292C"


def test_dates(spark):
    assert values(spark, dates.parse_numeric_date, ["born 5/3/87", "1.1.30", "1.1.31", "31.02.2020", "no", "05.12.1999"]) == [date(1987, 3, 5), date(2030, 1, 1), date(1931, 1, 1), None, None, date(1999, 12, 5)]
    assert values(spark, dates.parse_ro_date, ["din 7 Martie 2024", "7 xx 2024"]) == [date(2024, 3, 7), None]
    assert values(spark, dates.parse_birth, ["2020-99-99", "1.2.1980", "x", "5/11/1970"]) == ["2020-99-99", "1980-02-01", "", "1970-11-05"]


def test_jaro_winkler_rule():
    assert jaro_winkler("abcvwxyz", "cabvwxyz") == pytest.approx(0.9375)
    assert jaro_winkler("abcdxx", "abyyyyzz") == pytest.approx(0.6222, abs=1e-4)
    assert jaro_winkler("aleks", "alona") == pytest.approx(0.68)
    assert jaro_winkler("", "a") == 0 and jaro_winkler("", "") == 1
    assert name_score(["ana", "pop"], ["pop", "ana"]) == pytest.approx(1.0)


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
@settings(max_examples=200, deadline=None)
def test_jaro_winkler_bounds(a, b):
    assert 0 <= jaro_winkler(a, b) <= 1 and (jaro_winkler(a, b) == 1) >= (a == b)


def registry_tables(spark):
    d = lambda i, n, day, regime, measures: (i, n, date.fromisoformat(day), f"privind lista {i}", regime, "implementation", "in_force", measures, f"nr. {n}.pdf", [], [], None, None, None, n)
    decisions = spark.createDataFrame([d("1", 1, "2023-01-10", "UE", ["asset_freeze", "travel_ban"]), d("2", 2, "2024-07-01", "ONU", ["asset_freeze"]), d("x", None or 3, "2024-05-01", "UK", ["asset_freeze"])], schemas.DECISION)

    def s(i, dec, name, kind="person", idnp=None, birth=None, aliases=(), md=None, moldova=False, docs=(), nr=None, regime="UE", active=True):
        return (i, dec, nr or i.split("-")[1], kind, name, list(aliases), birth and date.fromisoformat(birth), [], idnp, [dict(kind="act", series=a, number=b, raw="") for a, b in docs], regime, active, moldova, (None, md and date.fromisoformat(md)), 1, int(i.split("-")[1]))

    subjects = spark.createDataFrame([
        s("1-1", "1", "POPX, Anna", idnp="2001234567890", md="2024-08-01", moldova=True, docs=[("AB", "1234567")]),
        s("2-2", "2", "Anna Popx", idnp="2001234567890", regime="ONU", aliases=["Anna P"]),
        s("1-3", "1", "Ion Zidaru", birth="1970-01-02"), s("x-4", "x", "Zidaru Ion", birth="1970-01-02", regime="UK"), s("x-5", "x", "Zidaru Ion", birth="1971-01-02", regime="UK"),
        s("2-6", "2", "Firma Exemplu", kind="entity", aliases=["FE", "Ex", "E1", "E2", "E3", "E4"], regime="ONU"), s("2-7", "2", "Old One", active=False, regime="ONU"), s("1-8", "1", "Marin Testescu"),
    ], schemas.SUBJECT)
    details = spark.createDataFrame([("1-8", "ministru al x", "", "", "legat de Zidaru Ion si Anna Popx", "", "", "", 1), ("1-1", "Funcții: director general; Alte informații: y", "", "", "", "", "", "", 1)], schemas.DETAIL)
    return subjects, details, decisions


def test_groups_and_score(spark):
    g = {r.name: r for r in registry.groups(*registry_tables(spark), AS_OF).collect()}
    assert len(g) == 5 + 0
    a = g["Anna Popx"]
    assert a.ids == ["2-2", "1-1"] or a.ids == ["1-1", "2-2"]
    assert a.regimes == ["ONU", "UE"] and a.decisions == ["1", "2"] and a.measures == ["asset_freeze", "travel_ban"] and a.cited == 1
    # local 30, regimes 25, decisions 10, mention 5, role 20, both 5, recent 5
    assert a.score == 100 and a.why == ["local", "2 regimes", "2 decisions", "cited by 1", "role 20", "both measures", "recent"]
    e = g["Firma Exemplu"]
    assert e.score == 10 + 5 and e.why == ["recent"]
    two = [r for r in registry.groups(*registry_tables(spark), AS_OF).collect() if "Zidaru" in r.name]
    assert sorted(len(r.ids) for r in two) == [1, 2] and all(r.cited == 0 for r in two)  # a pair of two groups cites none


def test_applied_statistics_and_rankings(spark):
    subjects, details, decisions = registry_tables(spark)
    rows = registry.with_applied(subjects.where("active"), decisions)
    applied = {r.id: r.applied for r in rows.collect()}
    assert applied["1-1"] == date(2024, 8, 1) and applied["1-3"] is None and applied["2-6"] == date(2024, 7, 1)
    rows = rows.withColumn("key", registry.person_key(F.col("idnp"), F.col("type"), F.col("name"), F.col("birthDate")))
    s = registry.stats(rows, registry.groups(subjects, details, decisions, AS_OF), decisions)
    assert sum(r["count"] for r in s["byType"].collect()) == 7 and s["scalars"].first().uniqueSubjects == 5
    assert s["latestDecision"].first().id == "2"
    assert [r.id for r in registry.latest(rows, 2).collect()] == ["1-1", "2-6"]
    assert registry.rankings(registry.groups(subjects, details, decisions, AS_OF))["relevance"].first().name == "Anna Popx"
    near = registry.neighbours(rows).where("id = '1-1'").orderBy("place").collect()
    assert [r.neighbour for r in near] == ["1-3", "1-8"]


def test_search_and_batch(spark):
    subjects, details, decisions = registry_tables(spark)
    rows = registry.with_applied(subjects, decisions)
    idx = search.index(rows.withColumn("key", registry.person_key(F.col("idnp"), F.col("type"), F.col("name"), F.col("birthDate"))))
    hits = search.run(idx, search.SearchSpec(q="anna")).collect()
    assert {r.id for r in hits} == {"1-1", "2-2"} and all(r.tier == 1 for r in hits)
    assert search.run(idx, search.SearchSpec(q="?!")).count() == 7  # no token matches all
    assert search.run(idx, search.SearchSpec(q="2001234567890", mode="idnp")).count() == 2
    assert search.run(idx, search.SearchSpec(q="ab 1234567", mode="document")).first().id == "1-1"
    assert search.run(idx, search.SearchSpec(q="1234", mode="document")).count() == 0
    assert search.run(idx, search.SearchSpec(measure="travel_ban")).count() == 3
    assert search.SearchSpec.from_params({"q": "x", "md": "1", "p": "-3"}) == search.SearchSpec(q="x", md=True, page=1)
    lines = read.upload(spark, ["﻿Nume;IDNP;Data nasterii", "Ana Popx;;", ";2001234567890;", "Marin Testescu;AB1234567;1.1.1990", "zzz qqq;;"])
    out = {r["query"]: r for r in fuzzy.screen(lines, idx, 0.82).collect()}
    assert out["2001234567890"].subject_id == "2-2"  # the last record wins
    assert out["AB1234567"].subject_id == "1-1" and out["AB1234567"].kind == "document"
    assert out["Marin Testescu"].status == "strong" and out["zzz qqq"].status == "none" and out["Ana Popx"].status in ("strong", "possible")
    found = search.run(idx, search.SearchSpec(q="Popx Annna"))
    assert fuzzy.suggestions(found, idx, "Попкс") is None and fuzzy.suggestions(found, idx, "Popxx Anna").count() >= 1
    plan = fuzzy.find(spark.createDataFrame([(1, "Ana", "")], "query_id int, query string, birth string"), idx)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_neighbours_under_ties(spark):
    numbers = ["5"] * 8 + ["4"] * 9 + ["6"] * 3 + ["9", "1", "x", None, "-2147483648", "2147483647"]
    rows = [(f"i{o}", d, "person", n, o) for d, shift in (("1", 0), ("2", 100)) for o, n in enumerate(numbers, shift + 1)] + [("e", "1", "entity", "5", 900)]
    got = {}
    for r in registry.neighbours(spark.createDataFrame(rows, "id string, decisionId string, type string, listNumber string, ord int")).collect():
        got.setdefault(r.id, {})[r.place] = r.neighbour
    want = {}
    numbered = [r for r in rows if r[3] not in (None, "x")]
    for i, d, t, n, _ in numbered:
        near = sorted((abs(int(m) - int(n)), o, j) for j, e, u, m, o in numbered if (e, u) == (d, t) and j != i)[:6]
        if near:
            want[i] = {k: j for k, (*_, j) in enumerate(near, 1)}
    assert got == want and list(map(got["i8"].get, range(1, 7))) == ["i1", "i2", "i3", "i4", "i5", "i6"]


def test_extraction(spark):
    assert values(spark, extract.parse_idnp, ["IDNP: 1234567890123", "identificare de stat: 2001234567890", "identificare de stat 1234567890123", "numărul de identificare fiscal: 2001234567890", "cod personal 2001234567890", None]) == ["1234567890123", "2001234567890", None, None, None, None]
    docs = one(spark, extract.parse_documents(F.lit("Pașaport seria AB nr. 123 4567, act XY 765432"), F.lit(None).cast("string")))
    assert [(d.kind, d.series, d.number) for d in docs] == [("pasaport", "AB", "1234567"), ("pasaport", "XY", "765432")] or [(d.series, d.number) for d in docs][-1] == ("XY", "765432")
    listing = one(spark, extract.parse_listing(F.lit("UE - 1.2.2023; RM: 5.6.2024; RM - 31.02.2024")))
    assert listing.md == date(2024, 6, 5) and listing.foreign == date(2023, 2, 1)
    assert values(spark, extract.role_weight, ["Prim-ministru", "Director general", "membru", "x", None]) == [30, 20, 10, 0, 0]
    assert values(spark, lambda c: extract.field_after(c, "Data nașterii", "Locul"), ["DATA NAȘTERII: 1.2.1990 Locul x", "none"]) == ["1.2.1990", ""]
    assert values(spark, extract.is_bad_name, ["ab", "123 456", "Ion Pop"]) == [True, True, False]


def test_layout(spark):
    markup = '<page width="600" height="800"><word xMin="1" yMin="10" xMax="5" yMax="12">Nume</word><word xMin="100" yMin="11" xMax="110" yMax="12">A&amp;B</word><word xMin="1" yMin="14" xMax="9" yMax="16">next</word><word xMin="2" yMin="20" xMax="3" yMax="21"> </word></page>'
    words = read.words_from_markup(spark.createDataFrame([("f", markup)], "path string, markup string")).withColumnRenamed("path", "file")
    rows = layout.cluster_rows(words)
    assert [(r.text, r.row) for r in rows.orderBy("ord").collect()] == [("Nume", 0), ("A&B", 0), ("next", 1)]
    edges = spark.createDataFrame([("f", 1, [0.0, 90.0])], "file string, page int, edges array<double>")
    cells = {(r.row, r.column): r.text for r in layout.split_columns(rows, edges).collect()}
    assert cells == {(0, 0): "Nume", (0, 1): "A&B", (1, 0): "next"}
    starts = spark.createDataFrame([("k", float(x)) for x in (10, 12, 14, 50, 52, 90, 91, 92, 93)], "k string, x double")
    assert layout.largest_cluster_edge(starts, ["k"], "x").first().edge == 92.0


def test_publish(spark, tmp_path):
    rows = spark.createDataFrame([("a\"b", ["x", "y"], None)], "n string, m array<string>, z string")
    assert rows.select(publish.csv_line([F.col("n"), publish.joined(F.col("m")), F.col("z")])).first()[0] == '"a""b",x; y,'
    assert publish.payload(rows, "rows", "t") == '{"generatedAt":"t","rows":[{"n":"a\\"b","m":["x","y"],"z":null}]}\n'
    (tmp_path / "d").mkdir()
    for n, f in (("1", "old"), ("2", "new")):
        (tmp_path / "d" / f"{n}.json").write_text('{"a-1": {"function": "%s", "page": 3}}' % f)
    assert read.details(spark, str(tmp_path / "d")).first().function == "new"
    (tmp_path / "s.json").write_text('{"subjects": [{"id": "1-1", "name": "N"}]}')
    assert read.wrapped(spark, str(tmp_path / "s.json"), "subjects", schemas.SUBJECT).first().name == "N"


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
