"""Rows and columns of a page from placed words.

Words have file, page, ord, x0, y0, x1, y1, text. One page is bounded, so its
words may be gathered in an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rows import is_junk_line
from ..functions.text import fold

# Labels that begin the column of identification.
INFO_LABELS = ["functia", "functie", "cetatenie", "cetatenia", "sexul", "adresa", "grad", "titlu", "pozitie", "nationalitate"]


def leaders(values: DataFrame, keys: list[str], value: str, order: list[str], gap: float) -> DataFrame:
    """Adds cluster: a new one begins where value is more than gap past the first of the current one (L-01).

    The fold needs each key's values in order; a key is one page, or as bounded.
    """
    rest = [c for c in values.columns if c not in keys]
    held = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*rest).alias("row")))).alias("rows"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s, r):
        v = r["row"][value].cast("double")
        fresh = s["anchor"].isNull() | (v - s["anchor"] > gap)
        n = F.when(fresh, s["n"] + 1).otherwise(s["n"])
        return F.struct(F.when(fresh, v).otherwise(s["anchor"]).alias("anchor"), n.alias("n"), F.array_append(s["out"], n).alias("out"))

    numbers = F.aggregate("rows", start, step, lambda s: s["out"])
    return held.select(*keys, F.explode(F.arrays_zip(F.transform("rows", lambda r: r["row"]).alias("row"), numbers.alias("cluster"))).alias("z")).select(*keys, "z.row.*", "z.cluster")


def cluster_rows(words: DataFrame, gap: float = 3.2) -> DataFrame:
    """Adds the row of each word of a page (L-01)."""
    return leaders(words, ["file", "page"], "y0", ["y0", "x0", "ord"], gap).withColumnRenamed("cluster", "row")


def column_starts(rows: DataFrame, gap: float = 11) -> DataFrame:
    """The first word of each row, and words after a wide gap (L-04)."""
    w = Window.partitionBy("file", "page", "row").orderBy("x0", "ord")
    before = F.lag("x1").over(w)
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("x0") - F.col("before") >= gap)).drop("before")


def gap_clusters(values: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Adds cluster: a new one begins after a step wider than gap (L-05). Rows without a value come last."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value))
    jump = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return values.withColumn("_jump", jump).withColumn("cluster", F.sum("_jump").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_jump")


def upper_median(values: Column) -> Column:
    """The middle value, the upper of two (N-06)."""
    held = F.sort_array(F.collect_list(values))
    return F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int"))


def largest_cluster_edge(starts: DataFrame, keys: list[str], value: str, gap: float = 8) -> DataFrame:
    """The upper median of each key's largest cluster, of equal ones the leftmost (L-05)."""
    clusters = gap_clusters(starts, keys, value, gap).groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.min(value).alias("left"), upper_median(F.col(value)).alias("edge"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "left")
    return clusters.withColumn("place", F.row_number().over(w)).where("place = 1").select(*keys, "edge", "n")


def header_anchors(rows: DataFrame, words: dict[str, str]) -> DataFrame:
    """First x0 of each header word in the first row that has the name word and another (L-02, L-03)."""
    marks = {k: F.lower("text").rlike(p) for k, p in words.items()}
    by_row = rows.groupBy("file", "page", "row").agg(*(F.min(F.when(m, F.col("x0"))).alias(k) for k, m in marks.items()))
    others = [F.col(k).isNotNull() for k in words if k != "name"]
    some = others[0]
    for o in others[1:]:
        some = some | o
    w = Window.partitionBy("file", "page").orderBy("row")
    return by_row.where(F.col("name").isNotNull() & some).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def split_columns(rows: DataFrame, edges: DataFrame, slack: float = 5) -> DataFrame:
    """Text of each row and column; a word goes to the last edge at most slack right of it (L-07)."""
    placed = rows.join(F.broadcast(edges), ["file", "page"])
    column = F.greatest(F.size(F.filter("edges", lambda e: e <= F.col("x0") + slack)) - 1, F.lit(0))
    return placed.withColumn("column", column).groupBy("file", "page", "row", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "text"))), lambda w: w["text"]), " ").alias("text"))


def carry_forward(pages: DataFrame, column: str) -> DataFrame:
    """Pages without a value take the last one before (L-09)."""
    w = Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn(column, F.last(column, ignorenulls=True).over(w))


def assemble(rows: DataFrame, keys: list[str], order: list[str], is_start, text: str = "text", separator: str = " ") -> DataFrame:
    """Records of a file: a starting row opens one, other rows continue it (L-10)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("record", F.sum(F.when(is_start, 1).otherwise(0)).over(w)).where("record > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda r: r["_t"]), separator)
    return numbered.groupBy(*keys, "record").agg(F.count("*").alias("rows"), joined.alias(text))


def info_label(words: Column) -> Column:
    """Left edge of the first label of identification among a row's words, which have x0 and their folded text as f; null without one (L-06)."""
    hits = F.filter(words, lambda w, i: w["f"].isin(INFO_LABELS) | ((w["f"] == "data") & F.coalesce(F.get(words, i + 1)["f"], F.lit("")).startswith("naster")))
    return F.get(hits, F.lit(0))["x0"]


def snap_to_labels(places: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose second one moves to the labels under it, if three or more align inside its neighbours and more than 10 away (L-06).

    places has file, page, x0, a row for each row of words with a label; edges
    has file, page, edges. Pages without labels keep their edges.
    """
    best = largest_cluster_edge(places, ["file", "page"], "x0").where("n >= 3").select("file", "page", (F.col("edge") - 4).alias("_edge"))
    e = lambda i: F.get("edges", F.lit(i))
    moves = (F.size("edges") >= 3) & (F.col("_edge") > e(0) + 36) & (F.col("_edge") < e(2) - 24) & (F.abs(F.col("_edge") - e(1)) > 10)
    moved = F.concat(F.array(e(0), F.col("_edge")), F.slice("edges", 3, F.greatest(F.size("edges"), F.lit(1))))
    return edges.join(best, ["file", "page"], "left").withColumn("edges", F.when(moves, moved).otherwise(F.col("edges"))).drop("_edge")


def snap_info_edge(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``snap_to_labels`` by placed words: rows has file, page, row, ord, x0, text (L-06)."""
    word = F.struct("x0", "ord", F.col("_f").alias("f"))
    held = rows.withColumn("_f", fold(F.col("text"))).groupBy("file", "page", "row").agg(F.array_sort(F.collect_list(word)).alias("words"))
    return snap_to_labels(held.select("file", "page", info_label(F.col("words")).alias("x0")).where("x0 is not null"), edges)


def body_sample(lines: DataFrame, most: int = 160, pages: int = 12) -> DataFrame:
    """Rows under each header that are not junk, up to the next page with a header: at most so many, from so many pages (L-08).

    lines has file, page, row, text, header (whether the row is a page's
    header). Adds header_page. A limit is the operator's own: it takes a sample.
    """
    first = Window.partitionBy("file", "page")
    by_file = Window.partitionBy("file").orderBy("page", "row")
    at = F.min(F.when(F.col("header"), F.col("row"))).over(first)
    opened = lines.withColumn("_at", at).withColumn("header_page", F.last(F.when(F.col("_at").isNotNull(), F.col("page")), ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    under = opened.where((F.col("page") < F.col("header_page") + pages) & (F.col("_at").isNull() | (F.col("row") > F.col("_at"))))
    body = under.where((F.trim(F.coalesce("text", F.lit(""))) != "") & ~is_junk_line(F.col("text")))
    place = F.row_number().over(Window.partitionBy("file", "header_page").orderBy("page", "row"))
    return body.withColumn("_place", place).where(F.col("_place") <= most).drop("_place", "_at")


def is_footnote(words: Column, width: Column, edges: Column, slack: float = 12, share: float = 0.62) -> Column:
    """Six or more words, in order of x0, over most of a page's width that fewer than two edges meet (L-11)."""
    hits = F.size(F.filter(edges, lambda e: F.exists(words, lambda w: F.abs(w["x0"] - e) <= slack)))
    span = F.try_element_at(words, F.lit(-1))["x1"] - F.get(words, F.lit(0))["x0"]
    return (F.size(words) >= 6) & (span >= width * share) & (F.size(edges) > 0) & (hits < 2)


def footnote_rows(rows: DataFrame, pages: DataFrame, slack: float = 12, share: float = 0.62) -> DataFrame:
    """file, page, row of the rows that are footnotes (L-11).

    rows has file, page, row, x0, x1; pages has file, page, width, edges. Pages without edges have none.
    """
    held = rows.groupBy("file", "page", "row").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("words"))
    return held.join(pages, ["file", "page"]).where(is_footnote(F.col("words"), F.col("width"), F.col("edges"), slack, share)).select("file", "page", "row")
