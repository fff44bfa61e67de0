import itertools

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .util import SF, docs as table


def words(t):
    return (t or "").split()


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    given = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given[name] = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    dropped = set(given["quality"]) - set(given["near_dedup"])
    assert sum(quality.get(i) == 1 for i in dropped) <= 1 and sum(quality.get(i) == 0 for i in dropped) > 0

    def sets(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())

    held = {i: sets(t) for i, t in given["near_dedup"].items()}
    up = {i: i for i in held}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in itertools.combinations(held, 2):
        if held[a] and held[b] and 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert {i for i in held if find(i) == i} == set(given["passages"])

    low = {}
    for i, t in given["passages"].items():
        w = words(t)
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            low[k] = min(low.get(k, i), i)
    for i, t in given["passages"].items():
        w = words(t)
        gone = set()
        for j in range(len(w) - 49):
            if low[tuple(w[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        assert words(given["packing"][i]) == [x for j, x in enumerate(w) if j not in gone]

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    sizes = {}
    for r in docs.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(own.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in given["packing"].items()}


def test_near_dedup_drops_only_duplicate_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(5, b), (5, a), (5, a), (5, a + " z"), (6, a), (6, c), (7, b), (8, ""), (8, c + " z"), (8, None), (None, a)]
    out = corpus_pipeline.near_dedup(spark, table(spark, rows), SF)
    got = sorted(((r.doc_id or 0, (r.text or "")[:2]) for r in out.collect()))
    assert got == [(0, "a0"), (5, "a0"), (5, "b0"), (6, "c0"), (8, ""), (8, "")]
