import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sievebook.llm import bpe, bytekit, common, fingerprint, licenses, minhash, packing

from .util import SF, docs, edge_texts


def table(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_word_spans_and_hashes_match_regex():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB \t\né9-") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for mask, pattern in ((bytekit.SPACED, rb"[^\x20\x09-\x0D]+"), (bytekit.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        (lo, hi, data, offsets), = list(bytekit.chunks(pa.array(texts)))
        starts, ends = bytekit.word_spans(data, offsets, mask)
        rows = bytekit.row_of(starts, offsets)
        got = [(int(r), bytes(data[a:b]).lower()) for r, a, b in zip(rows, starts, ends)]
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, "".join(c.lower() if c.isascii() else c for c in t).encode())]
        assert got == want
        hashes = bytekit.span_hashes(data, starts, ends, bytekit.LOWER_DIGITS)
        assert len(set(zip([w for _, w in want], hashes.tolist()))) == len({w for _, w in want}) == len(set(hashes.tolist()))


def test_hashes_do_not_depend_on_segments(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000))
    (_, _, data, offsets), = list(bytekit.chunks(pa.array([text])))
    starts, ends = bytekit.word_spans(data, offsets, bytekit.SPACED)
    whole = bytekit.span_hashes(data, starts, ends, bytekit.DIGITS)
    monkeypatch.setattr(bytekit, "CHUNK", 64)
    assert (bytekit.span_hashes(data, starts, ends, bytekit.DIGITS) == whole).all()


def test_bpe_matches_tiktoken_and_round_trips(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = [(r.doc_id, r.text) for r in table(spark).collect()] + edge_texts()
    got = Counter(tuple(r) for r in bpe.encode_decode(docs(spark, rows), path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_decode(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_random_strings():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(1)
    codec.transducer.limit = 500  # states are dropped on the way
    for _ in range(4000):
        s = "".join(rng.choice(["the", "ing", "er", "ü", "😀", "a", "aa", "12", "!!", " ", "\n", "x", "='"]) for _ in range(rng.randint(0, 15)))
        assert [int(x) for x in codec.encode_text(s).split(",") if x] == own.encode_ordinary(s)


def test_stream_decoder_gives_whole_characters():
    decoder = bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    text = "aé€😀z" * 3
    parts = [decoder.feed([b]) for b in text.encode()] + [decoder.close()]
    assert b"".join(parts).decode() == text
    assert all(p.decode() is not None for p in parts)


def brute_components(rows, k=4):
    def words(t):
        return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))

    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i), i == find(i)) for i, s in sets)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    rows = [(r.doc_id, r.text) for r in table(spark).collect()]
    for i in range(60):  # mutations of one text, of mutations, and a passage in unlike texts
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 30)}"
        rows.append((5000 + i, " ".join(w)))
        rows.append((6000 + i, " ".join(base[:60] + [f"q{rng.randint(0, 9999)}" for _ in range(rng.randint(5, 60))])))
    rows += [(9000 + i, t) for i, t in edge_texts()]
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs(spark, rows), 4).collect())
    assert got == brute_components(rows)


def test_near_duplicates_null_ids_and_empty(spark):
    out = minhash.near_duplicates(docs(spark, [(None, "a b c d e"), (3, "a b c d e"), (4, "a b c d e")]), 4).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in out) == [(-1, None, True), (3, 3, True), (4, 3, False)]
    assert minhash.near_duplicates(docs(spark, []), 4).count() == 0


def test_near_duplicates_of_repeated_ids_go_by_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(5, b), (5, a), (5, None), (6, a), (7, b[:-3] + "x"), (8, c), (8, a), (3, c + " z"), (9, "")]
    assert Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows), 4).collect()) == Counter(
        [(5, 5, True)] * 3 + [(6, 5, False), (7, 5, False), (8, 3, False), (8, 5, False), (3, 3, True), (9, 9, True)]
    )


def test_packing_places_every_token_once(spark):
    rows = [(r.doc_id, r.text) for r in table(spark).collect()] + [(9000 + i, t) for i, t in edge_texts()] + [(None, "no id")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(docs(spark, rows), path, public_tokenizers.PATTERN).collect()
    reader = Tokenizer.from_file(path)
    reader.encode_special_tokens = True
    want = Counter()
    tokens = {}
    for i, t in rows:
        ids = [*reader.encode(t or "", add_special_tokens=False).ids, 0]
        tokens.setdefault(i, []).append(np.array(ids, "<u4"))
    for p in out:
        ids = tokens[p.doc_id][0]
        assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        want[p.doc_id] += p.length
    assert want == Counter({i: sum(map(len, x)) for i, x in tokens.items()})
    for i, x in tokens.items():
        if len(x) == 1:
            at = 0
            for p in sorted((p for p in out if p.doc_id == i), key=lambda p: p.start):
                assert p.start == at
                at += p.length
    sizes = []
    for _, group in itertools.groupby(sorted(out, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        at = 0
        for p in group:
            assert p.offset == at and p.length > 0
            at += p.length
        sizes.append(at)
    assert max(sizes) <= 1024 and all(s & (s - 1) == 0 for s in sizes)
    assert packing.pack(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_packing_ids_are_those_of_the_reader(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    reader = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|> x  <|endoftext|>  y", "<|endoftext|", "a" + " " * 1_100_000 + "b", "word " * 3000 + "<|endoftext|>\n\n z"]
    out = packing.pack(docs(spark, list(enumerate(texts))), path, public_tokenizers.PATTERN).collect()
    for i, t in enumerate(texts):
        ids = np.array([*reader.encode(t, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted((p for p in out if p.doc_id == i), key=lambda p: p.start)
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces]
        assert all(p.doc_tokens == len(ids) for p in pieces) and sum(p.length for p in pieces) == len(ids)


def test_least_squares_reproduces_a_fillable_histogram():
    histogram = np.zeros(1024, np.int64)
    histogram[[300, 724]] = 50
    histogram[[200, 400, 424]] = 30
    columns = packing.combinations(1024)
    counts = packing.repeat_counts(histogram, columns)
    used = Counter()
    for c, n in zip(columns, counts):
        for x in c:
            used[x] += n
    assert used[300] == used[724] == 50 and used[200] == used[400] == used[424] == 30


def test_fingerprints(spark):
    rows = [(r.doc_id, r.text) for r in table(spark).collect()] + [(9000 + i, t) for i, t in edge_texts()] + [(None, "no id"), (None, None)]
    out = fingerprint.fingerprints(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == Counter(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    same = {}
    for r in out:
        same.setdefault(dict(rows)[r.doc_id] if r.doc_id else None, set()).add(r.fingerprint)
    assert all(len(v) == 1 for k, v in same.items() if k)
    long = [r for r in out if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.35 > 0.15 > np.mean([r.near_next for r in long])
    assert fingerprint.fingerprints(docs(spark, [])).count() == 0
    lone = fingerprint.fingerprints(docs(spark, [(5, "alone in here")])).first()
    assert lone.near_next == 1.0


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(9)
    a = [f"w{rng.randint(0, 60)}" for _ in range(400)]
    errors = []
    for keep in (100, 200, 300, 380):
        b = a[:keep] + [f"v{rng.randint(0, 60)}" for _ in range(400 - keep)]
        s, some = fingerprint.signature(pa.array([" ".join(a), " ".join(b)]))
        x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
        true = sum((x & y).values()) / sum((x | y).values())
        errors.append(fingerprint.likeness(s[:1], s[1:], some[:1], some[1:])[0] - true)
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.1


def test_license_scan_matches_brute_force(spark):
    extra = [(9100, "All rights reserved. all rights RESERVED all rights"), (9101, "cc-by cc by, CC/BY"), (9102, "x GNU General Public License"), (9103, "general general public public license general public license"), (9104, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files, to deal in the software without restriction")]
    rows = [(r.doc_id, r.text) for r in table(spark).collect()] + [(9000 + i, t) for i, t in edge_texts()] + extra
    out = licenses.license_scan(docs(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))]
        hits = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        want[i, len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))] += 1
    assert Counter(tuple(r)[:6] for r in out) == want
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)
    assert "mit" in next(r for r in out if r.doc_id == 9104).labels


@pytest.mark.parametrize("small", [common.SMALL, 0])
def test_components_match_brute_force(spark, monkeypatch, small):
    """The second time with every hub treated as one of many rows."""
    monkeypatch.setattr(common, "SMALL", small)
    monkeypatch.setattr(common, "MANY", min(common.MANY, small))
    rng = random.Random(8)
    shapes = [[(1, i) for i in range(2, 400)], [(i, i + 1) for i in range(1000, 1040)], [(2000 + i, 2500) for i in range(200)], [(rng.randint(3000, 3300), rng.randint(3000, 3300)) for _ in range(200)], [(3000, 1)]]
    links = [e for s in shapes for e in s]
    rng.shuffle(links)
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = [tuple(r) for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()]
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert sorted(got) == sorted((x, find(x)) for x in linked)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_template_that_makes_no_text_alike_forms_no_pairs(spark):
    """Texts that share about 85 % of their shingles with all others: likeness 0.74."""
    template = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(template + [f"own{i}x{j}" for j in range(70)])) for i in range(300)]
    rows += [(1000 + i, " ".join(template + [f"few{i}x{j}" for j in range(20)])) for i in range(30)]  # alike among themselves
    table = docs(spark, rows)
    got = Counter(tuple(r) for r in minhash.near_duplicates(table, 4).collect())
    assert got == brute_components(rows)
    sets = table.select("doc_id", "text").mapInArrow(minhash._sets(4), "node long, n_shingles long, set_a long, set_b long, items binary")
    from pyspark.sql import functions as F

    first = rows[:300]
    nodes = sets.where("node < 1000").select("node", F.col("n_shingles").alias("n"), F.col("node").alias("label"))
    assert minhash.prefix_links(sets.select("node", "items"), nodes, 80).count() == 0 and len(first) == 300


@pytest.mark.parametrize("many", [common.MANY, 3])
def test_prefix_links_match_brute_force(spark, monkeypatch, many):
    """The second time with shingles of more than three texts split over tasks."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "MANY", many)
    rng = random.Random(11)
    rows = []
    for i in range(160):
        n = rng.randint(8, 60)
        base = rng.choice([range(0, 60), range(30, 90), range(50, 110)])
        rows.append((i, sorted({rng.choice(base) if rng.random() < 0.9 else 1000 + rng.randint(0, 300) for _ in range(n)})))
        if rng.random() < 0.5:
            rows.append((500 + i, sorted({*rows[-1][1][1:], 2000 + i} if rng.random() < 0.5 else rows[-1][1][:-1])))
    hashes = {v: int(h) for v, h in zip(range(3000), np.random.default_rng(1).integers(0, 1 << 63, 3000))}
    sets = spark.createDataFrame([(i, np.sort(np.array([hashes[v] for v in x], np.uint64)).tobytes(), len(x)) for i, x in rows], "node long, items binary, n long")
    nodes = sets.select("node", "n", F.col("node").alias("label"))
    links = {tuple(r) for r in minhash.prefix_links(sets.select("node", "items"), nodes, 80).collect()}
    held = {i: set(x) for i, x in rows}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(held, 2) if 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b])}

    def joined(edges):
        up = {i: i for i in held}

        def find(x):
            return x if up[x] == x else find(up[x])

        for a, b in sorted(edges):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
        return {i: find(i) for i in held}

    assert links <= want and joined(links) == joined(want) and len(want) > 50


def test_license_chains_match_brute_force():
    """The best chain of maximal matches by trying every predecessor of each."""
    own, rng = licenses.scanner(), random.Random(12)
    words = sorted({w for _, s in own.templates for w in s})
    for _ in range(300):
        text = []
        while len(text) < 40:
            _, sequence = rng.choice(own.templates)
            at = rng.randrange(len(sequence))
            text += sequence[at : at + rng.randint(1, 12)] + [rng.choice(words)] * rng.randint(0, 2)
        matches = []
        own.scan(text, 0, [], matches)
        for t, place, start, size in matches:
            assert own.templates[t][1][place : place + size] == text[start : start + size]
        want = {}
        for t in {m[0] for m in matches}:
            found, best = sorted({m[1:] for m in matches if m[0] == t}, key=lambda m: (m[1], m[0], m[2])), []
            for place, start, size in found:
                near = [c for (p, s, n), c in zip(found, best) if 0 <= start - s - n <= licenses.GAP and 0 <= place - p - n <= licenses.GAP]
                best.append(size + max(near, default=0))
            label, sequence = own.templates[t]
            want[label] = max(want.get(label, 0.0), min(1.0, max(best) / len(sequence)))
        assert own.covered(matches) == want
