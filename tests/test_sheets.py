"""Receipts, sheets and the first page, on invented records."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sievebook.functions import dates
from sievebook.operators import registry, search, sheets

from test_registry import AS_OF, registry_tables


@pytest.fixture(scope="module")
def tables(spark):
    subjects, details, decisions = registry_tables(spark)
    rows = registry.with_applied(subjects, decisions).withColumn("key", registry.person_key(F.col("idnp"), F.col("type"), F.col("name"), F.col("birthDate"))).cache()
    return subjects, rows, details, decisions


def test_receipt(tables):
    _, rows, _, decisions = tables
    at, indexed = datetime(2025, 1, 2, 3, 4, 5), search.index(rows)
    spec = search.SearchSpec(q="zidaru", regime="UE", year="1900")
    r = sheets.receipt(indexed, decisions, spec, AS_OF, at, most=2)
    assert r.listed and r.hits == 3 and r.shown.count() == 2 and r.active == 7 and r.latest.first().id == "2"
    assert len(r.number) == 8 and r.number == sheets.receipt(indexed, decisions, spec, AS_OF, at).number != sheets.receipt(indexed, decisions, spec, "x", at).number
    assert not sheets.receipt(indexed, decisions, search.SearchSpec(q="nimeni"), AS_OF, at).listed


def test_subject_sheet(tables):
    _, rows, details, decisions = tables
    s = sheets.subject_sheet(rows, details, decisions, "1-3", AS_OF)
    row = s.subject.first()
    assert row.name == "Ion Zidaru" and row.group_size == 2 and row.group_regimes == ["UE", "UK"] and row.group_measures == ["asset_freeze", "travel_ban"]
    assert row.legal_basis == "nr. 1 din 10.01.2023" and row.reason.startswith("Măsura este dispusă prin decizia nr. 1 din 10.01.2023.")
    assert [(r.id, r.decision) for r in s.siblings.collect()] == [("x-4", "nr. 3 din 01.05.2024")]
    assert {r.step: r.date for r in s.timeline.collect()}["in force"] == date(2025, 6, 30)
    assert row.local == (row.listing.md or date(2023, 1, 10))
    assert {r.id for r in s.neighbours.collect()} == {"1-1", "1-8"}
    assert sheets.subject_sheet(rows, details, decisions, "1-8", AS_OF).subject.first().reason == "legat de Zidaru Ion si Anna Popx"
    none = sheets.subject_sheet(rows, details, decisions, "zz", AS_OF)
    assert [t.count() for t in (none.subject, none.timeline, none.siblings, none.neighbours)] == [0, 0, 0, 0]


def test_decision_sheet(tables):
    _, rows, _, decisions = tables
    changed = decisions.withColumn("amendedBy", F.when(F.col("id") == "1", F.array(F.lit("2"), F.lit("2"))).otherwise(F.col("amendedBy")))
    d = sheets.decision_sheet(search.index(rows), changed, "2", q="anna")
    assert {r.type: r["count"] for r in d.counts.collect()} == {"person": 1, "entity": 1}
    assert [r.id for r in d.amends.collect()] == ["1"] and [r.id for r in d.subjects.collect()] == ["2-2"] and d.decision.first().number == 2
    assert sheets.decision_sheet(rows, changed, "2").subjects.count() == 2 and sheets.decision_sheet(rows, changed, "zz").subjects.count() == 0


def test_home(tables):
    subjects, rows, details, decisions = tables
    h = sheets.home(rows, registry.groups(subjects, details, decisions, AS_OF), decisions)
    k, applied = h["kpis"].first(), [r.applied for r in rows.where("active and applied is not null").collect()]
    assert (k.records, k.subjects, k.regimes, k["last"], k.last_batch) == (7, 5, 3, max(applied), applied.count(max(applied)))
    assert h["latestDecision"].first().id == "2" and {r.regime: r["count"] for r in h["byRegime"].collect()} == {"UE": 3, "ONU": 2, "UK": 2}
    assert h["programs"].first()["count"] == 3 and h["recent"].first().applied == max(applied) and sum(r["count"] for r in h["byMonth"].collect()) == len(applied)
    assert sheets.home(rows.limit(0), registry.groups(subjects.limit(0), details, decisions, AS_OF), decisions)["kpis"].first().records == 0


def test_lag(spark):
    assert spark.range(1).select(dates.lag_days(F.lit("2024-01-01").cast("date"), F.lit("2024-01-03").cast("date")).alias("x")).first().x == 2
