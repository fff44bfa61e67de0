import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np

from sievebook.llm import neighbours, quality, urls, warc

from .util import SF, docs, edge_texts


def test_url_filter_parts_and_rules(spark):
    given = [None, "", "no scheme", "http://", "HTTP://Sub.Example.ORG/es/x?q=/y#z", "https://example.org/en/12", "https://example.org/fr", "https://a.org", "http://x.com/fr/1", "http://x.com/de/", "ftp://X.y/p?a://b/c", "://h/p#?", "http://org/", "http://notexample.org.evil.net/es/", "http://casino.example.net/click.php?aff=77"]
    rows = spark.createDataFrame([(i, u, "h", "x", None) for i, u in enumerate(given)] + [(None, "http://a.org/", "h", None, "r")], "page_id long, url string, host string, path string, rule string")
    out = urls.judge(rows).collect()

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), path

    for r in out:
        host, path = parts(given[r.page_id] if r.page_id is not None else "http://a.org/")
        fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[0])
        assert r.verdict == (best[1] or ("block" if r.score >= 0.5 else "allow"))
    assert next(r for r in out if r.page_id == 14).verdict == "block"
    assert urls.judge(rows.where("false")).count() == 0


def test_url_grams(spark):
    from pyspark.sql import functions as F

    grams = spark.range(1).select(urls.grams(F.lit("abc"), "h")).first()[0]
    parts = ["^ab", "abc", "bc$", "^abc", "abc$"]
    want = spark.range(1).select(*(F.pmod(F.xxhash64(F.lit("h"), F.lit(x)), F.lit(urls.BUCKETS)) for x in parts)).first()
    assert grams == list(want)


def test_url_model_on_held_out_rows(spark):
    table = urls.labelled()
    random.Random(4).shuffle(table)
    half = len(table) // 2
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(table[half:])], "page_id long, url string")
    out = {r.page_id: r.verdict == "block" for r in urls.judge(rows, rules=[], labelled_urls=table[:half]).collect()}
    assert np.mean([out[i] == bool(y) for i, (_, y) in enumerate(table[half:])]) > 0.85


def test_url_score_matches_plain_model(spark):
    """Features, fit and score in plain Python, the hashes being Spark's."""
    from pyspark.sql import functions as F

    table = [('http://a."b"\\\\c.net/x', 1), ("https://library.example.com/en/1", 0), ("http://casino.example.net/win", 1), ("no scheme", 0)]
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(table)] + [(9, None)], "page_id long, url string")
    out = {r.page_id: r for r in urls.judge(rows, rules=[], labelled_urls=table).collect()}

    def pieces(host, path):
        return [(f, m[i : i + n]) for f, x in (("h", host), ("p", path)) for m in [f"^{x}$"] for n in urls.SIZES for i in range(len(m) - n + 1)]

    every = sorted({p for r in out.values() for p in pieces(r.host, r.path)})
    hashed = spark.createDataFrame(every, "f string, g string").select("f", "g", F.pmod(F.xxhash64("f", "g"), F.lit(urls.BUCKETS)).alias("h")).collect()
    number = {(r.f, r.g): r.h for r in hashed}
    own = {i: [number[p] for p in pieces(r.host, r.path)] for i, r in out.items()}
    weights, bias = urls.fit([(own[i], y) for i, (_, y) in enumerate(table)])
    for i, r in out.items():
        z = bias + sum(float(f"{weights[h]:.6g}") for h in own[i]) / max(1, len(own[i])) ** 0.5
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.verdict == ("block" if r.score >= 0.5 else "allow")
    assert {r.verdict for r in urls.judge(rows, rules=[], labelled_urls=[]).collect()} == {"allow"}


def test_url_plan_is_native(spark):
    plan = urls.judge(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_quality_on_labels_and_edges(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in quality.judge(table).collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert np.mean([out[r.doc_id].kept == (r.quality == 1) for r in labels]) > 0.97
    clean = [out[r.doc_id].kept for r in labels if r.quality == 1]
    assert np.mean(clean) > 0.98
    kept = quality.keep_good(table)
    assert kept.schema == table.schema and kept.count() == sum(r.kept for r in out.values())
    assert quality.judge(docs(spark, edge_texts())).count() == len(edge_texts())
    assert quality.judge(docs(spark, [])).count() == 0 and quality.keep_good(docs(spark, [])).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    junk = rng.random(20000) < 0.15
    code = np.zeros(20000, np.int64)
    for i, (hit, false) in enumerate([(0.8, 0.01), (0.7, 0.05), (0.6, 0.01), (0.5, 0.02), (0.5, 0.02), (0.6, 0.03)]):
        code |= (rng.random(20000) < np.where(junk, hit, false)).astype(np.int64) << i
    code |= ((rng.random(20000) < np.where(junk, 0.02, 0.9)).astype(np.int64)) << 6
    codes, counts = np.unique(code, return_counts=True)
    post, accuracy, share = quality.estimate(codes, counts.astype(float))
    found = dict(zip(codes.tolist(), post))
    assert np.mean([(found[c] >= 0.5) == j for c, j in zip(code.tolist(), junk)]) > 0.97
    assert accuracy[0] > accuracy[1] and 0.1 < share < 0.2


def brute_nearest(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0):
            good.setdefault(i, []).append([float(x) for x in v])
    width = Counter(len(v) for x in good.values() for v in x).most_common(1)[0][0]
    good = {i: np.array(min(v for v in x if len(v) == width)) for i, x in good.items() if any(len(v) == width for v in x)}
    out, matrix, ids = set(), np.array(list(good.values())), np.array(list(good))
    for i, v in good.items():
        if i % every == 0:
            d = np.sqrt(((matrix - v) ** 2).sum(axis=1))
            order = np.lexsort((ids, d))
            near = [j for j in order if ids[j] != i][:k]
            out |= {(i, n + 1, int(ids[j]), round(float(d[j]), 9)) for n, j in enumerate(near)}
    return out


def test_neighbours_exact_on_small_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(400, None), (500, [0.0] * 8), (600, [float("nan")] + [1.0] * 7), (700, [None] + [1.0] * 7), (None, [1.0] * 8), (800, [float("inf")] * 8)]
    rows += [(900, [1.0] * 9), (201, rows[7][1]), (200, rows[8][1]), (200, rows[8][1])]
    table = spark.createDataFrame([(i, v, "q", 1) for i, v in rows], "vec_id long, embedding array<float>, tree string, part int")
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.nearest(table, 10, 100, leaf=1000).collect()}
    assert got == brute_nearest(rows, 10, 100)
    assert neighbours.nearest(table.where("false")).count() == 0
    assert neighbours.nearest(table.where("vec_id = 0")).count() == 0
    assert {r.vec_id for r in neighbours.nearest(table.where("vec_id in (0, 1, 2)")).collect()} == {1, 2}


def test_neighbours_of_one_vector_held_by_most_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 900, 2)] + [(i, rng.normal(size=3).tolist()) for i in range(1, 900, 2)] + [(100, [1e200, 0.0, -1e200])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(table, 3, 50).collect()]
    least = lambda q: [i for i in (0, 2, 4, 6) if i != q][:3]
    assert {g for g in got if g[0] != 100} == {(q, n + 1, i, 0.0) for q in range(0, 900, 50) if q != 100 for n, i in enumerate(least(q))}


def compared_share(table, k=10):
    """Share of all rows that a query is compared with, counted from the leaves it takes."""
    points = [(r.vec_id, np.array(r.embedding, float)) for r in table.orderBy("vec_id").collect()]
    x = np.array([v for _, v in points])
    sample = x[np.random.default_rng(0).permutation(len(x))[: neighbours.SAMPLE]]
    depth = min(round(np.log2(len(x) / neighbours.LEAF)), int(np.log2(len(sample) / neighbours.LEAST)))
    forest = neighbours.fit(sample, neighbours.TREES, depth)
    held = [neighbours.leaves(x, t, cuts, depth) for t, cuts in enumerate(forest)]
    shares = []
    for i, v in points:
        if i % 100 == 0:
            far = np.sort(neighbours.distances(sample, v))
            near = far[far > 0][max(1, round(k * len(sample) / len(x))) - 1]
            seen = np.zeros(len(x), bool)
            for t, f in neighbours.route(v, forest, depth, neighbours.REACH * near**2 * depth / x.shape[1]):
                seen |= held[t] == f
            shares.append(seen.mean())
    return float(np.mean(shares))


def recall(table):
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = {(q, j) for q, _, j, _ in brute_nearest(rows, 10, 100)}
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(table, 10, 100).collect()}
    assert len(got) == len(want)
    return len(got & want) / len(want)


def test_neighbours_recall_on_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    table = spark.createDataFrame([(i, (centres[rng.integers(60)] + 0.3 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(6000)], "vec_id long, embedding array<float>")
    share, found = compared_share(table), recall(table)
    assert share < 0.15 and found >= 0.95, (share, found)


def test_neighbours_recall_without_clusters(spark):
    """Vectors of all directions, whose neighbours are nearly as far as the rest."""
    table = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    share, found = compared_share(table), recall(table)
    assert share < 0.6 and found >= 0.9, (share, found)


def parse_warc(raw):
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        body, raw = raw[:n], raw[n:]
        assert raw[:4] == b"\r\n\r\n"
        raw = raw[4:]
        yield fields, body.partition(b"\r\n\r\n")[2]


def test_warc_round_trip(spark, tmp_path):
    pages = [(3, "http://a/\r\nb", "x" * 1000), (1, None, "x" * 1000), (2, "http://é", None), (7, "u", ""), (None, "u", "x" * 1000), (None, "u", "lone"), (5, "u", "éü😀" * 300000), (6, "u", "y\r\n\r\nWARC/1.1\r\n"), (1, None, "x" * 1000)]
    table = spark.createDataFrame([(*p, 1, "s") for p in pages], "page_id long, url string, html string, size int, first string")
    got = Counter(tuple(r) for r in warc.archive_pages(table).collect())
    want = Counter()
    for i, _, html in pages:
        b = (html or "").encode()
        first = min((j for j, _, h in pages if j is not None and (h or "") == (html or "")), default=None)
        revisit = first is not None and first != i
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert got == want
    path = str(tmp_path / "archive")
    warc.write_archive(table, path, chunk=1000)
    rows = spark.read.parquet(path).orderBy("record_no", "chunk_no").collect()
    assert max(len(r.data) for r in rows) < 1500
    found = Counter((f["WARC-Type"], body) for f, body in parse_warc(b"".join(warc.stream(rows))))
    assert found == Counter(("response", (h or "").encode()) if k[3] == "response" else ("revisit", b"") for (i, _, h), k in zip(pages, [next(k for k in want if k[0] == i and k[1] == len((h or "").encode())) for i, _, h in pages]))
    assert warc.archive_pages(table, least=10**9).where("record_type = 'revisit'").count() == 0
    assert warc.archive_pages(table.where("false")).count() == 0


def test_warc_of_an_oversized_payload(spark, tmp_path):
    from pyspark.sql import functions as F

    size = 40 << 20
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") == 1, F.repeat(F.concat(F.lit("é0123456789abc"), F.col("id").cast("string")), F.lit(size // 16))).otherwise("x").alias("html"))
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    archive = spark.read.parquet(path)
    assert archive.agg(F.max(F.octet_length("data"))).first()[0] < warc.CHUNK + 1000
    assert archive.groupBy("record_no").count().agg(F.max("count")).first()[0] == size // warc.CHUNK
    digest = base64.b32encode(hashlib.sha1("é0123456789abc1".encode() * (size // 16)).digest()).decode()
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_archive(archive).collect() if r.page_id == 1} == {(1, size, digest)}


def test_warc_damage_is_found(spark, tmp_path):
    import pytest

    pages = spark.createDataFrame([(1, "u", "x" * 5000), (2, "u", "short")], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path, chunk=1000)
    archive = spark.read.parquet(path)
    assert warc.read_archive(archive).count() == 2
    for lost in ("chunk_no = 2", "chunk_no = 0 and not last", "chunk_no = 4"):
        with pytest.raises(Exception, match="lacks"):
            warc.read_archive(archive.where(f"not ({lost})")).collect()
    from pyspark.sql import functions as F

    changed = archive.withColumn("data", F.when(F.col("chunk_no") == 1, F.concat(F.lit(b"y"), F.expr("substring(data, 2)"))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(changed).collect()
