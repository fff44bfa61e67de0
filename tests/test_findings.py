"""Queries against their SQL on rows that the driver's small tables lack, and how their work is dealt."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_queries import SF, plain

from sievebook import queries, registry_queries  # noqa: F401 (registers more queries)
from sievebook.functions import text


def against_sql(spark, folder, name, **tables):
    """The rows of a query on these tables (lists of dicts), after they were found equal to those of its SQL."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows if isinstance(rows, pa.Table) else pa.Table.from_pylist(rows), f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, str(folder))
    want = con.execute(queries.ORACLES[name])
    rows = plain(got.collect(), got.columns)
    assert rows == plain(want.fetchall(), [c[0] for c in want.description])
    return rows


def test_gap_clusters_of_fractions_and_missing_times(spark, tmp_path):
    times = [900_000, 43_201_000_000, 43_201_500_000 + 43_200_000_000, 86_402_500_000 + 43_200_000_000, None, None]
    events = pa.table({"user_id": pa.array([1] * 6 + [None] * 2, "int64"), "event_id": list(range(8)), "ts": pa.array(times + [0, 50_000_000_000], pa.timestamp("us"))})
    rows = against_sql(spark, tmp_path, "gap_clusters", events=events)
    assert [r[0] for r in sorted(rows, key=lambda r: r[1])][:2] == [0, 0]


def test_fold_names_its_text_once(spark):
    plan = spark.range(1).select(text.fold(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") == 1


def test_fold_of_rare_letters_and_marks(spark):
    given = ["Ѝ½ ﬁn Ⅳ", "é҈ Ѯ", "Țară … Юлия №1", None, "İX"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", text.fold(F.col("t")).alias("b"), text.fold(F.col("t"), "search").alias("s")).orderBy("i").collect()
    assert [(r.b, r.s) for r in rows] == [("1 2 fin iv", "n"), ("e", "e"), ("tara iulia 1", "tara iulia 1"), ("", ""), ("ix", "ix")]


@pytest.mark.parametrize("name", ["names_in_lists", "decision_heads", "built_subjects", "rejected_names"])
def test_long_rows_of_one_file_are_dealt_to_tasks(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert "rlike" not in plan.lower()[plan.rindex("RepartitionByExpression") :]
