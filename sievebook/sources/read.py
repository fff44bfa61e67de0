"""Sources."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text


def files(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """(path, content) of PDF files, or of those named (S-01)."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf")
    return reader.load(only or folder).select("path", "content")


def _tool(command: list[str], data: bytes) -> str:
    done = subprocess.run(command, input=data, capture_output=True, check=False)
    return done.stdout.decode("utf-8", errors="replace")


def layout_text(pdfs: DataFrame) -> DataFrame:
    """(path, text, markup) by the external tools; empty where they are missing (S-02, S-05)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = shutil.which("pdftotext") is not None
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                plain = _tool(["pdftotext", "-layout", "-", "-"], content.as_py()) if there else ""
                markup = _tool(["pdftotext", "-bbox-layout", "-", "-"], content.as_py()) if there else ""
                yield pa.RecordBatch.from_pydict({"path": [path.as_py()], "text": [plain], "markup": [markup]})

    return pdfs.select("path", "content").mapInArrow(run, "path string, text string, markup string")


def needs_ocr(layout: Column) -> Column:
    """Fewer than 80 characters of text (S-04)."""
    return F.length(text.strip(layout)) < 80


def words_from_markup(pages: DataFrame, key: str = "path", markup: str = "markup") -> DataFrame:
    """One row per placed word of page markup; entities unescaped, empty words dropped (S-05)."""
    page = pages.select(key, F.posexplode(F.regexp_extract_all(markup, F.lit(r"(?s)(<page .*?</page>)"), F.lit(1))).alias("page", "body"))
    size = lambda n: F.regexp_extract("body", rf'<page [^>]*{n}="([0-9.]+)"', 1).try_cast("double")
    word = page.select(key, (F.col("page") + 1).alias("page"), size("width").alias("page_width"), size("height").alias("page_height"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)(<word [^>]*>.*?</word>)"), F.lit(1))).alias("ord", "w"))
    at = lambda n: F.regexp_extract("w", rf'{n}="([0-9.]+)"', 1).try_cast("double")
    plain = F.regexp_replace(F.regexp_extract("w", r"(?s)>(.*?)</word>", 1), "<[^>]*>", "")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(sign))
    return word.select(key, "page", "page_width", "page_height", "ord", at("xMin").alias("x0"), at("yMin").alias("y0"), at("xMax").alias("x1"), at("yMax").alias("y1"), F.trim(plain).alias("text")).where("text <> ''")


def wrapped(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Rows of the array ``field`` of a JSON document, with ord (S-06)."""
    rows = spark.read.schema(f"{field} array<struct<{', '.join(':'.join(c.strip().split(' ', 1)) for c in _columns(schema) if c.strip().split(' ', 1)[0] != 'ord')}>>").json(path, multiLine=True)
    return rows.select(F.posexplode(field).alias("ord", "r")).select("r.*", "ord")


def _columns(schema: str) -> list[str]:
    out, depth, last = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(last)
            last = ""
        else:
            last += c
    return [*out, last]


def details(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON objects keyed by id, of later files the value counts (S-07, U-02)."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    rows = raw.select("file", F.explode(F.from_json("value", f"map<string,{schemas.DETAIL_STRUCT}>")).alias("id", "d"))
    return rows.groupBy("id").agg(F.max_by("d", "file").alias("d")).select("id", "d.*")


def upload(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(row_no, raw) batch lines of a pasted or uploaded table; the head of it is read on the driver (S-09)."""
    lines = [x for x in (l.rstrip("\r\n") for l in lines) if x.strip()]
    if lines:
        lines[0] = lines[0].lstrip("\ufeff")
    if not lines:
        return spark.createDataFrame([], "row_no int, raw string")
    sign = max(";\t,", key=lambda s: lines[0].count(s))
    cells = lambda line: [c.strip().strip('"').strip() for c in line.split(sign)]
    head = [c.lower() for c in cells(lines[0])]
    at = {k: next((i for i, c in enumerate(head) if c.startswith(p)), None) for k, p in (("name", ("nume", "name", "denumire")), ("id", ("idnp", "ident", "cod", "document")), ("birth", ("data n", "nasc", "birth")))}
    out = []
    if any(v is not None for v in at.values()):
        for line in lines[1:]:
            row = cells(line)
            get = lambda k, row=row: row[at[k]] if at[k] is not None and at[k] < len(row) else ""
            main = get("name") or get("id")
            if main:
                out.append(f"{main}; {get('birth')}" if get("birth") else main)
            if get("name") and get("id"):
                out.append(get("id"))
    else:
        out = ["; ".join([c for c in cells(line) if c][:2]) for line in lines]
    return spark.createDataFrame(list(enumerate(out, 1)), "row_no int, raw string")
