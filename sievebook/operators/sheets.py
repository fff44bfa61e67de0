"""What is shown of a search, a subject, a decision and the whole registry, as tables.

Rows are those of the registry with applied and key (registry.with_applied and
registry.person_key); a sheet's lists stay tables of their own, as a subject
or a decision may have many rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from . import registry, search


@dataclass(frozen=True)
class Receipt:
    """The proof of one search."""

    number: str
    query: str
    mode: str
    at: datetime
    version: str
    active: int
    hits: int
    shown: DataFrame
    latest: DataFrame

    @property
    def listed(self) -> bool:
        return self.hits > 0


def receipt(indexed: DataFrame, decisions: DataFrame, spec: search.SearchSpec, version: str, at: datetime, most: int = 50) -> Receipt:
    """A receipt of a search by its words and mode only, without facets; it shows the first hits and counts all (B-03)."""
    plain = search.SearchSpec(q=spec.q, mode=spec.mode)
    found = search.run(indexed, plain)
    moment = at.isoformat()
    number = indexed.sparkSession.range(1).select(text.fnv1a(F.lit(f"{plain.q}|{plain.mode}|{moment}|{version}")).alias("h")).first().h
    latest = decisions.where("date is not null and kind <> 'report'").orderBy(F.desc("date"), "ord").limit(1)
    return Receipt(number, plain.q, plain.mode, at, version, indexed.where("active").count(), found.count(), found.limit(most), latest)


def _label(number: Column, date: Column) -> Column:
    return F.concat_ws(" ", F.lit("nr."), number.cast("string"), F.when(date.isNotNull(), F.concat(F.lit("din "), F.date_format(date, "dd.MM.yyyy"))))


@dataclass(frozen=True)
class SubjectSheet:
    """One row of the subject, and its lists."""

    subject: DataFrame
    timeline: DataFrame
    siblings: DataFrame
    neighbours: DataFrame


def subject_sheet(rows: DataFrame, details: DataFrame, decisions: DataFrame, id: str, as_of: str, near: int = 6) -> SubjectSheet:
    """A record with its group's regimes and measures, reason and legal basis; its dates; its group's other records; the records next to it (B-04).

    The local date is the record's or the decision's, also where others of the
    decision have dates of their own. An empty reason is told by the decision.
    An unknown id gives empty tables.
    """
    active = rows.where("active")
    own = rows.where(F.col("id") == id)
    group = active.join(F.broadcast(own.select("key")), "key", "left_semi")
    d = decisions.select(F.col("id").alias("decisionId"), F.col("number").alias("decision_number"), F.col("date").alias("decision_date"), F.col("title").alias("decision_title"), "instruments", "amendedBy", F.col("measures").alias("decision_measures"))
    lists = group.join(d, "decisionId", "left").agg(
        F.array_sort(F.collect_set("regime")).alias("group_regimes"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("decision_measures")))).alias("group_measures"), F.count("*").alias("group_size")
    )
    base = own.drop("measures", "decisionDate", "decisionKind").join(d, "decisionId", "left")
    told = details.where(F.col("id") == id).select("function", "birthPlace", "gender", "reason", "notes", "identifiersText", F.col("page").alias("detail_page")).limit(1)
    label = _label(F.col("decision_number"), F.col("decision_date"))
    full = base.join(told, how="left").join(lists)
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")).otherwise(F.trim(F.concat(F.lit("Măsura este dispusă prin decizia "), label, F.lit(". "), F.coalesce("decision_title", F.lit("")))))
    local, source = F.coalesce("listing.md", "decision_date"), F.col("listing.foreign")
    subject = full.withColumns({"reason": reason, "legal_basis": label, "local": local, "lag_days": dates.lag_days(source, local), "page": F.coalesce("detail_page", "page")})
    step = lambda date, what, place: F.struct(F.lit(place).alias("place"), date.alias("date"), F.lit(what).alias("step"))
    steps = F.array(step(source, "source", 1), step(F.col("decision_date"), "decision", 2), step(local, "local", 3), step(F.lit(as_of).cast("date"), "in force", 4))
    timeline = subject.select(F.inline(F.filter(steps, lambda s: s["date"].isNotNull())))
    siblings = group.where(F.col("id") != id).join(d.select("decisionId", "decision_number", "decision_date"), "decisionId", "left").select("id", "decisionId", _label(F.col("decision_number"), F.col("decision_date")).alias("decision"), "regime")
    mine = F.broadcast(own.select("decisionId", "type", F.col("listNumber").try_cast("int").alias("_nr")).limit(1))
    away = F.abs(F.col("listNumber").try_cast("int") - F.col("_nr"))
    neighbours = active.join(mine, ["decisionId", "type"]).where(F.col("id") != id).orderBy(F.asc_nulls_last(away), "ord").limit(near).select("id", "name", "listNumber")
    return SubjectSheet(subject, timeline, siblings, neighbours)


@dataclass(frozen=True)
class DecisionSheet:
    """One row of the decision, its counts by type, the decisions it amends, and its records in the order of the annex."""

    decision: DataFrame
    counts: DataFrame
    amends: DataFrame
    subjects: DataFrame


def decision_sheet(rows: DataFrame, decisions: DataFrame, id: str, q: str = "") -> DecisionSheet:
    """A decision with its active records, of which a query keeps those that hold all its words (B-05).

    Records can be exported whole by publish.full_lines. Words are looked for
    in the blob of search.index, which the rows then need.
    """
    own = decisions.where(F.col("id") == id)
    people = rows.where(F.col("active") & (F.col("decisionId") == id))
    amends = decisions.select(F.col("id"), "number", "date", F.explode("amendedBy").alias("_by")).join(F.broadcast(own.select(F.col("number").cast("string").alias("_by"))), "_by", "left_semi").select("id", "number", "date").distinct()
    wanted = search.query_tokens(rows, q) if q else []
    shown = people.where(search.matches(F.col("blob"), wanted)) if wanted else people
    return DecisionSheet(own, registry.counts(people, "type"), amends, shown.orderBy("page", F.asc_nulls_last(F.col("listNumber").try_cast("int")), "ord"))


def home(rows: DataFrame, groups: DataFrame, decisions: DataFrame, most: int = 7, programs: int = 8) -> dict[str, DataFrame]:
    """Indicators and short lists of the first page: kpis, recent, moldova, international, byRegime, byType, byMonth, programs (B-06)."""
    active = rows.where("active")
    unique = active.agg(F.count("*").alias("records"), F.count_distinct("key").alias("subjects"), F.count_distinct("regime").alias("regimes"), F.max("applied").alias("last"))
    batch = active.where("applied is not null").groupBy("applied").agg(F.count("*").alias("last_batch")).withColumnRenamed("applied", "_on")
    with_subjects = decisions.agg(F.count_if(F.col("subjectCount") > 0).alias("decisions"))
    linked = groups.agg(F.count_if("moldova").alias("moldova"))
    kpis = unique.join(F.broadcast(batch), F.col("last") == F.col("_on"), "left").drop("_on").join(with_subjects).join(linked).withColumn("last_batch", F.coalesce("last_batch", F.lit(0)))
    ranked = registry.rankings(groups)
    title = decisions.select(F.col("id").alias("decisionId"), F.col("regime").alias("decision_regime"), text.title_program(F.col("title")).alias("program"))
    largest = registry.counts(active, "decisionId").orderBy(F.desc("count"), "decisionId").limit(programs).join(title, "decisionId", "left")
    latest = decisions.where("kind <> 'report' and status = 'in_force'").orderBy(F.desc_nulls_last("date"), F.desc_nulls_last("number")).limit(1)
    by_month = registry.counts(active.select(dates.month(F.col("applied")).alias("month")), "month")
    return {
        "kpis": kpis, "latestDecision": latest, "recent": active.orderBy(F.desc_nulls_last("applied"), F.collate(F.col("name"), "ro"), "ord").limit(most),
        "moldova": ranked["moldova"].limit(most), "international": ranked["international"].limit(most),
        "byRegime": registry.counts(active, "regime").orderBy(F.desc("count"), "regime"), "byType": registry.counts(active, "type"), "byMonth": by_month, "programs": largest,
    }
