"""Search over the registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


@dataclass
class SearchSpec:
    """State of a search; from URL parameters with defaults (S-11)."""

    q: str = ""
    mode: str = "name"
    type: str = "all"
    regime: str = "all"
    decision: str = "all"
    measure: str = "all"
    year: str = "all"
    md: bool = False
    sort: str = "relevance"
    page: int = 1

    @classmethod
    def from_params(cls, params: dict[str, str]) -> SearchSpec:
        known = {k: v for k, v in params.items() if k in cls.__dataclass_fields__ and k not in ("md", "page")}
        page = params.get("p", "1")
        return cls(**known, md=params.get("md") == "1", page=max(1, int(page) if page.isdigit() else 1))


def query_tokens(df: DataFrame, q: str) -> list[str]:
    """The search tokens of a typed query, by the same expressions as the registry's."""
    return df.sparkSession.range(1).select(text.tokens(F.lit(q)).alias("t")).first().t


def facets(spec: SearchSpec, columns: set[str]) -> Column:
    """All facet conditions joined by and; 'all' switches one off (P-02)."""
    out = F.lit(True)
    for value, column in ((spec.type, "type"), (spec.regime, "regime"), (spec.decision, "decisionId")):
        if value != "all" and column in columns:
            out = out & (F.col(column) == value)
    if spec.measure != "all":
        out = out & F.array_contains("measures", spec.measure)
    if spec.md:
        out = out & F.col("moldova")
    if spec.year != "all":
        out = out & F.startswith(F.coalesce(F.col("applied").cast("string"), F.lit("")), F.lit(spec.year))
    return out


def matches(blob: Column, wanted: list[str]) -> Column:
    """Every token somewhere in the blob (P-06); no token matches all rows (X-03)."""
    out = F.lit(True)
    for t in wanted:
        out = out & F.contains(blob, F.lit(t))
    return out


def tier(name_tokens: Column, name: Column, wanted: list[str]) -> Column:
    """0 same tokens, 1 all tokens begin words, 2 all within, 3 otherwise (O-01)."""
    same = F.array_join(F.array_sort(name_tokens), " ") == " ".join(sorted(wanted))
    begins = F.lit(True)
    for t in map(F.lit, wanted):
        begins = begins & _any_begins(name_tokens, t)
    return F.when(same, 0).when(begins, 1).when(matches(name, wanted), 2).otherwise(3)


def _any_begins(words: Column, start: Column) -> Column:
    return F.exists(words, lambda w: F.startswith(w, start))


def doc_keys(documents: Column) -> Column:
    """Number, and series with number, in lower case without other characters (P-05)."""
    clean = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    one = lambda d: F.array(clean(d["number"]), F.concat(clean(d["series"]), clean(d["number"])))
    return F.filter(F.array_distinct(F.flatten(F.transform(F.coalesce(documents, F.array().cast("array<struct<kind:string,series:string,number:string,raw:string>>")), one))), lambda k: k != "")


def index(rows: DataFrame) -> DataFrame:
    """Adds what searches read: name tokens, blob and document keys."""
    variants = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.coalesce("idnp", F.lit(""))), doc_keys(F.col("documents")))
    return rows.withColumns({"name_tokens": text.tokens(F.col("name")), "doc_keys": doc_keys(F.col("documents")), "blob": F.array_join(text.tokens(F.array_join(variants, " ")), " ")})


def by_identifier(rows: DataFrame, q: str) -> DataFrame:
    """Records of a 13-digit number; other queries find none (P-03)."""
    digits = "".join(c for c in q if c.isdigit())
    return rows.where(F.col("idnp") == digits) if len(digits) == 13 else rows.where("false")


def by_document(rows: DataFrame, q: str) -> DataFrame:
    """Records with a document of at least five characters (P-04)."""
    key = "".join(c for c in q.lower() if c.isascii() and c.isalnum())
    return rows.where(F.array_contains("doc_keys", key)) if len(key) >= 5 else rows.where("false")


def run(indexed: DataFrame, spec: SearchSpec) -> DataFrame:
    """Hits with their tier and rank, in the order asked for (P-01 to P-06, O-02, O-03)."""
    rows = indexed.where(F.col("active") & facets(spec, set(indexed.columns)))
    if spec.mode == "idnp":
        found = by_identifier(rows, spec.q).withColumn("tier", F.lit(0))
    elif spec.mode == "document":
        found = by_document(rows, spec.q).withColumn("tier", F.lit(0))
    else:
        wanted = query_tokens(indexed, spec.q)
        found = rows.where(matches(F.col("blob"), wanted)).withColumn("tier", tier(F.col("name_tokens"), F.array_join("name_tokens", " "), wanted))
    collated = F.collate(F.col("name"), "ro")
    order = {"name": [collated], "recent": [F.desc(F.coalesce(F.col("applied").cast("string"), F.lit(""))), collated]}.get(spec.sort, ["tier", collated])
    return found.orderBy(*order, "ord")


def grouped(hits: DataFrame, order: list) -> DataFrame:
    """Groups in the order of their first hit (O-04)."""
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    return ranked.where("place = 1").orderBy(*order)


def page(df: DataFrame, order: list, number: int, size: int = 20) -> DataFrame:
    """One page, the number clamped to the last (O-05)."""
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)
