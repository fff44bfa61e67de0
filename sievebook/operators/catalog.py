"""The catalog of decisions, values of facets, published groups and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

#: Fields of a published group, in order (P-11).
SLIM = ["id", "ids", "name", "type", "aliases", "idnp", "birthDate", "citizenship", "role", "regimes", "decisions", "measures", "moldova", "firstApplied", "lastApplied", "cited", "score", "why"]
#: Lists of rankings in the order of publication.
LISTS = ["relevance", "international", "moldova", "regimes", "entities", "vessels"]


def catalog(decisions: DataFrame, q: str = "", regime: str = "all", kind: str = "all") -> DataFrame:
    """Decisions of a regime and kind whose number, title or regime hold the folded query, with year and place: newest first, undated last (P-07, O-13)."""
    rows = decisions
    for value, column in ((regime, "regime"), (kind, "kind")):
        if value != "all":
            rows = rows.where(F.col(column) == value)
    blob = text.fold(F.concat_ws(" ", F.coalesce(F.col("number").cast("string"), F.lit("null")), "title", "regime"), "search")
    rows = rows.where(F.contains(blob, text.fold(F.lit(q), "search")))
    place = F.row_number().over(Window.orderBy(F.desc(F.coalesce(F.col("date").cast("string"), F.lit("0"))), F.desc(F.coalesce("number", F.lit(0))), "ord"))
    return rows.withColumns({"year": F.coalesce(F.date_format("date", "yyyy"), F.lit("Fără dată")), "place": place})  # decisions are a small table


def facet_values(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(facet, value): regimes, years and types of active records, kinds of decisions, and decisions in force that list records (U-04)."""
    active = rows.where("active")
    listing = decisions.where("kind = 'implementation' and status = 'in_force' and coalesce(subjectCount, 0) > 0")
    parts = [
        active.select(F.lit("regime").alias("facet"), F.col("regime").alias("value")),
        active.where("applied is not null").select(F.lit("year"), F.date_format("applied", "yyyy")),
        active.where(F.col("type").isin("person", "entity", "vessel")).select(F.lit("type"), "type"),
        decisions.select(F.lit("kind"), "kind"),
        listing.select(F.lit("decision"), "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def slim(groups: DataFrame) -> DataFrame:
    """Groups as they are published: the first member's id, at most five aliases (P-11)."""
    return groups.withColumns({"id": F.get("ids", F.lit(0)), "aliases": F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, 5)}).select(*SLIM)


def listed(rankings: dict[str, DataFrame]) -> DataFrame:
    """(list, at, id, key, role, score) of every member of every ranked group."""
    parts = [df.select(F.lit(name).alias("list"), F.lit(i).alias("at"), F.explode("ids").alias("id"), "key", "role", "score") for i, (name, df) in enumerate((n, rankings[n]) for n in LISTS if n in rankings)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked_group(rankings: dict[str, DataFrame]) -> DataFrame:
    """(id, list, key, score): the ranked group of each record, the first of relevance, moldova and entities that has it (J-04)."""
    found = listed({n: rankings[n] for n in ("relevance", "moldova", "entities") if n in rankings})
    return found.groupBy("id").agg(F.min_by(F.struct("list", "key", "score"), "at").alias("g")).select("id", "g.*")


def roles(rankings: dict[str, DataFrame]) -> DataFrame:
    """(id, role) of the members of ranked groups that have a role; later lists count (J-05)."""
    return listed(rankings).where(F.coalesce("role", F.lit("")) != "").groupBy("id").agg(F.max_by("role", "at").alias("role"))


def batches(rows: DataFrame, dates: int = 12, names: int = 14) -> DataFrame:
    """The newest dates of application, each with its records, persons, decisions and first names in the order of the language (G-15).

    The names are told by rank, so that a date with most of the records is
    never gathered.
    """
    dated = rows.where("active and applied is not null")
    newest = dated.groupBy("applied").agg(F.count("*").alias("records"), F.count_if(F.col("type") == "person").alias("persons"), F.array_sort(F.collect_set("decisionId")).alias("decisions")).orderBy(F.desc("applied")).limit(dates)
    place = F.row_number().over(Window.partitionBy("applied").orderBy(F.collate(F.col("name"), "ro"), "ord"))
    first = dated.join(F.broadcast(newest.select("applied")), "applied", "left_semi").withColumn("place", place).where(F.col("place") <= names)
    shown = first.groupBy("applied").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
    return newest.join(shown, "applied").withColumn("others", F.col("records") - F.col("persons"))


def peaks(months: DataFrame, n: int = 3) -> DataFrame:
    """The months with most records; of equal ones the earlier (O-14)."""
    return months.orderBy(F.desc("count"), "bucket").limit(n)
