"""Records of the tables of files, from placed words.

Everything goes by file: windows and groups have a file, a page or a row as
their key, each of which is one document's and bounded. Texts are folded where
they are read, before a group or a window, so that no later step repeats it.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..functions.extract import is_bad_name
from ..functions.rows import is_column_index_row, is_junk_line, leading_number, section_type
from ..functions.text import clean_ws, fold, let, strip
from . import layout, narrative, subjects

# Words that tell notes from entries, in footnotes, in numbered rows, in names that are none.
NOTE_WORDS = {"footnote": "precizare|modificare efectuata|corrigendum|http", "numbered": "precizare|modificare efectuata|http", "rejected": "precizare|modificare efectuata|corrigendum"}
# The columns' header words, the name's window from the left, windows of the others around their word.
HEADERS = {"name": "^nume(?:le)?$", "info": "^informa", "motive": "^motiv", "date": "^data$"}
NAME_LEFT, BEFORE, AFTER, UNALIGNED, APART = 28, 90, 14, 28, 24

_COLUMNS = ["name", "info", "reason", "dates"]
_NO_TEXTS = "array<string>"


def _cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the folder of spark.checkpoint.dir, as several steps read them. Only a session on one machine (tests) may lack it; it gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sievebook-"))
    return df.checkpoint(eager=True)


def page_rows(words: DataFrame) -> DataFrame:
    """file, page, row, width, words (by x0, with their folded text f), text, header, junk and kind of each row (L-01, L-02).

    words has file, page, page_width, ord, x0, y0, x1, y1, text. A row is a
    header if it names the name and another column.
    """
    placed = layout.cluster_rows(words.select("file", "page", "ord", "x0", "y0", "x1", "text", F.col("page_width").alias("width"), fold(F.col("text")).alias("f")))
    word = F.struct("x0", "y0", "ord", "x1", "text", "f")
    rows = placed.groupBy("file", "page", "row").agg(F.first("width").alias("width"), F.array_sort(F.collect_list(word)).alias("words"))
    has = lambda p: F.exists("words", lambda w: w["f"].rlike(p))
    text = let(F.array_join(F.transform("words", lambda w: w["text"]), " "), clean_ws)
    rows = rows.withColumns({"text": text, "header": has(HEADERS["name"]) & has("^informa|^motiv|^identificare$")})
    # The window parts these from what filters on them.
    first = F.min(F.when(F.col("header"), F.col("row"))).over(Window.partitionBy("file", "page"))
    rows = rows.withColumns({"junk": is_junk_line(F.col("text")), "kind": section_type(F.col("text"))}).withColumn("header_row", first)
    before = Window.partitionBy("file").orderBy("page").rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("header_page", F.max(F.when(F.col("header_row").isNotNull(), F.col("page"))).over(before))


def header_edges(rows: DataFrame) -> DataFrame:
    """file, header_page, edges of the pages with a header, as far as there is one for info and motive (L-03 to L-05, L-08).

    The edge of a column is the upper median of the most frequent starts of
    cells at most BEFORE left and AFTER right of its header word, in a sample
    of the rows under it; with fewer than three it lies UNALIGNED left of the
    word. Edges less than APART from the one before are no columns.
    """
    starts = F.transform(F.filter("words", lambda w, i: (i == 0) | (w["x0"] - F.get("words", i - 1)["x1"] >= 11)), lambda w: w["x0"])
    heads = rows.where("header and row = header_row")
    at = lambda p: F.get(F.filter("words", lambda w: w["f"].rlike(p)), F.lit(0))["x0"]
    wanted = heads.select("file", "header_page", "width", *(at(p).alias(k) for k, p in HEADERS.items())).where("info is not null and motive is not null")
    anchors = wanted.select("file", "header_page", "width", F.posexplode(F.array(*HEADERS)).alias("column", "anchor")).where("anchor is not null")
    low = F.when(F.col("column") == 0, NAME_LEFT).otherwise(F.col("anchor") - BEFORE)
    anchors = anchors.select("file", "header_page", "column", "anchor", low.alias("low"), F.least(F.col("anchor") + AFTER, "width").alias("high"))
    sample = layout.body_sample(rows.select("file", "page", "row", "text", "header", starts.alias("starts"))).select("file", "header_page", "starts")
    near = anchors.join(sample, ["file", "header_page"]).withColumn("start", F.get(F.filter("starts", lambda s: s.between(F.col("low"), F.col("high"))), F.lit(0)))
    near = near.where("start is not null").select("file", "header_page", "column", "start")
    key = ["file", "header_page", "column"]
    learned = layout.largest_cluster_edge(near, key, "start").drop("n").join(near.groupBy(*key).agg(F.count("*").alias("n")), key).where("n >= 3")
    placed = anchors.join(learned, key, "left").withColumn("edge", F.coalesce("edge", F.col("anchor") - UNALIGNED))
    held = placed.groupBy("file", "header_page").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "edge"))), lambda p: p["edge"]).alias("all"))
    none = F.array().cast("array<double>")
    kept = F.aggregate("all", none, lambda s, e: F.when((F.size(s) == 0) | (e - F.try_element_at(s, F.lit(-1)) >= APART), F.concat(s, F.array(e))).otherwise(s))
    return held.select("file", "header_page", kept.alias("edges"))


def _cells(words: Column, edges: Column) -> Column:
    """Four texts: of each word the column is the last edge at most 5 right of it (L-07)."""
    place = lambda w: F.greatest(F.size(F.filter(edges, lambda e: e <= w["x0"] + 5)) - 1, F.lit(0))
    text = lambda i: F.array_join(F.transform(F.filter(words, lambda w: place(w) == i), lambda w: w["text"]), " ")
    return F.transform(F.array(*(text(i) for i in range(len(_COLUMNS)))), clean_ws)


def _entry(cells: Column) -> Column:
    """Struct of number (null of a row that continues one), name, info, reason, dates of a row's cells."""

    def parts(s: Column) -> Column:
        alone = strip(s["cells"][0]).rlike(r"^\d{1,2}\*?$")
        name = F.when(s["n"].isNotNull(), s["n"]["rest"]).when(alone, "").otherwise(s["cells"][0])
        return F.struct(s["n"]["number"].alias("number"), names.detach_labels(name, s["cells"][1]).alias("d"), s["cells"].alias("cells"))

    def flat(s: Column) -> Column:
        return F.struct(s["number"].alias("number"), s["d"]["name"].alias("name"), s["d"]["info"].alias("info"), s["cells"][2].alias("reason"), s["cells"][3].alias("dates"))

    return let(let(let(cells, lambda c: F.struct(c.alias("cells"), leading_number(c[0]).alias("n"))), parts), flat)


def _events(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """file, page, row, event, kind, text, entry of the rows that mean something.

    Events are title (a section's title over a header), section, footnote,
    numbered (a numbered note), start and more.
    """
    by_page = rows.select("file", "page", "header_page").distinct().join(edges, ["file", "header_page"]).select("file", "page", "edges")
    body = rows.where("header_page is not null and (page > header_page or row > header_row)")
    labels = body.select("file", "page", layout.info_label(F.col("words")).alias("x0")).where("x0 is not null")
    placed = body.where("text <> '' and not junk").join(layout.snap_to_labels(labels, by_page), ["file", "page"])
    across = layout.is_footnote(F.col("words"), F.col("width"), F.col("edges"))
    lines = placed.select("file", "page", "row", "kind", "text", "header", "words", "edges", across.alias("across"))
    known = F.when(F.col("across"), F.when(fold(F.col("text")).rlike(NOTE_WORDS["footnote"]), "footnote")).when(F.col("header"), None).when(F.col("kind").isNotNull(), "section").otherwise("line")
    lines = lines.withColumn("event", known).where("event is not null")
    other = lines.where("event <> 'line'").select("file", "page", "row", "event", "kind", "text")
    cells = lines.where("event = 'line'").select("file", "page", "row", _cells(F.col("words"), F.col("edges")).alias("cells"))
    entry = cells.where(~is_column_index_row(F.col("cells"))).select("file", "page", "row", _entry(F.col("cells")).alias("entry"))
    note = (F.col("entry.name") == "") & fold(F.concat("entry.reason", "entry.info")).rlike(NOTE_WORDS["numbered"])
    event = F.when(F.col("entry.number").isNull(), "more").when(note, "numbered").otherwise("start")
    titles = rows.where("page = header_page and row < header_row and row >= header_row - 4 and kind is not null")
    titles = titles.select("file", "page", "row", F.lit("title").alias("event"), "kind", "text")
    return other.unionByName(titles).unionByName(entry.withColumn("event", event), allowMissingColumns=True)


def extract_table(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records; file and warnings of files with a table) (L-10).

    Records have file, ord from 1, listNumber, type, name, info, reason, dates,
    notes and page. A numbered row opens a record, rows without number go on
    with it, a section's title ends it. Notes go to the open record, else to
    the last one kept; records whose name is none are dropped, or are notes of
    the last one kept. Pages before the first header are not read; files
    without header, and an empty table, give no rows.
    """
    rows = _cut(page_rows(words))
    by_file = Window.partitionBy("file")
    heads = rows.where("page = header_page").select("file", "header_page").distinct().join(header_edges(rows), ["file", "header_page"], "left")
    usable = F.when(F.size("edges") >= 3, F.col("edges"))
    edges = _cut(heads.withColumn("edges", F.last(usable, ignorenulls=True).over(by_file.orderBy("header_page").rowsBetween(Window.unboundedPreceding, 0))))
    events = _cut(_events(rows, edges.where("edges is not null")))
    order = by_file.orderBy("page", "row").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("event").isin("start", "section")
    kind = F.when(F.col("event").isin("title", "section"), F.col("kind"))
    events = events.withColumns({"segment": F.count_if(opens).over(order), "type": F.coalesce(F.last(kind, ignorenulls=True).over(order), F.lit("person"))})
    fields = F.struct("page", "row", "event", "type", "text", "entry")
    held = events.where("event <> 'title'").groupBy("file", "segment").agg(F.array_sort(F.collect_list(fields)).alias("rows"))
    # A segment is a record if a numbered row opens it.
    first = F.get("rows", F.lit(0))
    held = held.select("file", "segment", "rows", first.alias("first"), (first["event"] == "start").alias("open"))
    told = F.filter("rows", lambda r: r["event"].isin("start", "more"))
    joined = lambda c: let(F.array_join(F.transform(told, lambda r: r["entry"][c]), " "), clean_ws)
    of_note = F.when(F.col("open"), F.lit(" ")).otherwise(F.lit(""))
    notes = F.transform(
        F.filter("rows", lambda r: r["event"].isin("footnote", "numbered")),
        lambda r: F.when(r["event"] == "footnote", r["text"]).otherwise(F.concat(r["entry"]["reason"], of_note, F.when(F.col("open"), r["entry"]["info"]).otherwise(""))),
    )
    held = held.select("file", "segment", "open", F.col("first.page").alias("page"), F.col("first.type").alias("type"), F.col("first.entry.number").alias("listNumber"), *(joined(c).alias(c) for c in _COLUMNS), notes.alias("said"))
    tidy = held.withColumn("tidy", names.tidy_name(F.col("name"), F.array_join("said", " ")))
    kept = F.col("open") & (F.col("tidy.name") != "") & ~is_bad_name(F.col("tidy.name"))
    after = by_file.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    judged = tidy.withColumn("kept", kept).withColumn("owner", F.max(F.when(F.col("kept"), F.col("segment"))).over(after)).where("owner is not null")
    remark = ~F.col("kept") & (F.col("reason") != "") & fold(F.concat_ws(" ", "tidy.name", "reason")).rlike(NOTE_WORDS["rejected"])
    none = F.array().cast(_NO_TEXTS)
    added = F.when(F.col("kept"), none).when(~F.col("open"), F.col("said")).when(remark, F.array(clean_ws(F.concat_ws(" ", "name", "reason")))).otherwise(none)
    record = F.struct("listNumber", "type", F.col("tidy.name").alias("name"), "info", "reason", "dates", F.col("tidy.notes").alias("notes"), "page")
    whole = judged.groupBy("file", "owner").agg(F.first(F.when(F.col("kept"), record), ignorenulls=True).alias("r"), F.array_sort(F.collect_list(F.struct("segment", added.alias("added")))).alias("added"))
    more = F.array_join(F.flatten(F.transform("added", lambda a: a["added"])), " ")
    text = whole.select("file", "owner", "r.*", more.alias("_more")).withColumn("notes", let(F.concat_ws(" ", "notes", "_more"), clean_ws))
    ranked = text.withColumn("ord", F.row_number().over(by_file.orderBy("owner")))
    records = _cut(ranked.select("file", "ord", "listNumber", "type", "name", "info", "reason", "dates", "notes", "page"))
    unsure = heads_unsure(edges)
    found = records.select("file").distinct().withColumn("_found", F.lit(True))
    empty = F.when(F.col("_found").isNull(), F.array(F.lit("tabel_fara_randuri"))).otherwise(none)
    warnings = unsure.join(found, "file", "left").select("file", F.concat("unsure", empty).alias("warnings"))
    return records, warnings


def heads_unsure(edges: DataFrame) -> DataFrame:
    """file, unsure: a warning for each page with a header whose columns are not known, in order."""
    pages = F.array_sort(F.collect_list(F.when(F.col("edges").isNull(), F.col("header_page"))))
    return edges.groupBy("file").agg(F.transform(pages, lambda p: F.concat(F.lit("coloane_nesigure_pagina_"), p)).alias("unsure"))


def registry(words: DataFrame, files: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subjects, details, report) of the decisions' files, from table or running text (U-01, L-14, P-09, P-10).

    files has file, text and ocr; decisions has file, id, kind, regime,
    status. Files whose decision is not listed give no rows. The report has
    file, method, subjects and warnings: first of a scan, then of its table,
    of its text, of its names.
    """
    read = files.join(decisions.where(subjects.listed_in(F.struct("kind", "status"))).select("file"), "file", "left_semi")
    pictures = read.where(F.coalesce("ocr", F.lit(False))).select("file")
    tabled, unsure = extract_table(words.join(read.select("file"), "file", "left_semi").join(pictures, "file", "left_anti"))
    told = narrative.extract_narrative(read).withColumn("dates", F.lit(""))
    used, report = narrative.choose(read, tabled, told.select(*tabled.columns))
    found, details, rejected = subjects.build_subjects(used.drop("method"), decisions)
    report = report.join(unsure.withColumnRenamed("warnings", "_unsure"), "file", "left")
    report = report.withColumn("warnings", F.concat(F.coalesce("_unsure", F.array().cast(_NO_TEXTS)), "warnings")).drop("_unsure")
    return found, details, subjects.with_rejected(report, rejected)
