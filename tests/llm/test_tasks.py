"""Tasks of operators on slim tables follow the rows, not the number of shuffle partitions: the driver keeps something of each task."""

import numpy as np
import public_tokenizers
import pytest

from sievebook.llm import minhash, packing

from .util import SF

WIDE = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def wide(spark):
    before = {k: spark.conf.get(k, None) for k in WIDE}
    for k, v in WIDE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tasks(spark, name, work):
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        out = sorted(tuple(r) for r in work().collect())
    finally:
        context._jsc.clearJobGroup()
    track = context.statusTracker()
    stages = {s for j in track.getJobIdsForGroup(name) for s in (track.getJobInfo(j) or ((), (), ())).stageIds}
    return sum(i.numTasks for i in map(track.getStageInfo, stages) if i), out


def test_confirmed_links_are_in_few_tasks(wide):
    sets = wide.createDataFrame([(i, bytearray(np.arange(100, dtype=np.uint64).tobytes())) for i in range(1, 6)], "node long, items binary")
    pairs = wide.createDataFrame([(1, i) for i in range(2, 6)], "a long, b long").repartition(64, "b")
    assert minhash.confirmed(sets, pairs, 80).rdd.getNumPartitions() == 1


def test_tasks_of_near_duplicates_and_packing(wide):
    docs = wide.read.parquet(f"{SF}/documents.parquet")
    near = lambda: minhash.near_duplicates(docs, k=4, percent=80)
    pack = lambda: packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    n_near, got = tasks(wide, "near", near)
    n_pack, packed = tasks(wide, "pack", pack)
    wide.conf.set("spark.sql.shuffle.partitions", "3")
    assert got == sorted(tuple(r) for r in near().collect())
    assert packed == sorted(tuple(r) for r in pack().collect())
    # 731 and 549 when written; 1912 and 1687 before.
    assert n_near < 1200 and n_pack < 900, (n_near, n_pack)
