"""The three CSV exports on invented records."""

import glob

from sievebook import registry_queries as made
from sievebook.sources import publish


def test_full_csv_file(spark, tmp_path):
    lines = publish.full_lines(*made.tables(spark, "/root/testdata/sf0.001"))
    path = str(tmp_path / "csv")
    publish.write_lines(lines, "ord", publish.FULL, path)
    raw = b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/part-*")))
    assert raw.startswith(b"\xef\xbb\xbfid,nume,aliasuri,") and raw.endswith(b"\r\n") and raw.count(b"\n") == raw.count(b"\r\n") == 151
    rows = raw.decode("utf-8-sig").split("\r\n")
    assert len(rows[0].split(",")) == 16 and rows[1].split(",")[0].endswith("-0") and rows[150].split(",")[0].endswith("-149")


def test_cells(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(publish.csv_line([F.lit('a "b"'), F.lit(None), F.lit("c;d"), F.lit("e\nf")]).alias("full"), publish.csv_line([F.lit("c;d")], publish.BROWSER_SIGNS).alias("browser")).first()
    assert row.full == '"a ""b""",,c;d,"e\nf"' and row.browser == '"c;d"'
