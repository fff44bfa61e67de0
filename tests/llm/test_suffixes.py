import hashlib
import random
from collections import Counter

import numpy as np

from sievebook.llm import suffixes

from .util import SF, docs, edge_texts


def brute(rows, threshold=50):
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for j in range(len(b) - threshold + 1):
                w = b[j : j + threshold]
                low[w] = min(low.get(w, i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for j in range(len(b) - threshold + 1):
                if low[b[j : j + threshold]] < i:
                    gone[j : j + threshold] = b"\1" * threshold
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


def check(spark, rows):
    got = Counter(tuple(r) for r in suffixes.remove_repeats(docs(spark, rows)).collect())
    want = brute(rows)
    assert got == want, ((got - want).most_common(2), (want - got).most_common(2))


def test_matches_brute_force_on_documents(spark):
    check(spark, [(r.doc_id, r.text[:6000]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect() if r.text is not None])


def test_matches_brute_force_on_made_cases(spark):
    rng = random.Random(2)

    def noise(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    p = noise(49), noise(50), noise(51), noise(200)
    rows = [(100 + i, noise(rng.randint(0, 90)) + rng.choice(p) + noise(rng.randint(0, 90)) + rng.choice(p)) for i in range(60)]
    rows += [(200, "a" * 300), (201, "a" * 120), (202, "ab" * 100), (203, "b" + "ab" * 60), (204, "a" * 49), (205, "a" * 50)]
    rows += [(300, "x" + p[3]), (300, p[3] + "y"), (None, p[3]), (None, None), (50, p[3][:60])]
    rows += [(i, (t or "")[:3000] if t is not None else None) for i, t in edge_texts()]
    rng.shuffle(rows)
    check(spark, rows)


def test_empty(spark):
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


def test_words(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one two {passage} three"), (2, f"x {passage}\ny"), (3, " ".join(passage.split()[:49]) + " z"), (4, None), (5, f"x {passage}\ny"), (None, passage), (6, "a b"), (7, "a b")]
    out = {r.doc_id: r for r in suffixes.without_repeats(docs(spark, rows)).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "x \ny" and out[3].text == rows[2][1] and out[4].text is None
    assert out[5].text.split() == [] and out[None].text == passage and out[7].text == "a b"
    assert out[2].node == "x" and len(out) == 8


def test_sliding_windows():
    x = np.random.default_rng(1).integers(0, 1000, 400).astype(np.uint32)
    for w in (1, 2, 7, 31, 32):
        assert suffixes.slide(x, w, True).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]
        assert suffixes.slide(x, w, False).tolist() == [max(x[i : i + w]) for i in range(len(x) - w + 1)]


def test_contexts_of_one_hash_but_other_symbols_are_told_apart(monkeypatch):
    """With a hash that is the same for all contexts only the symbols decide."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 100, 60).astype(np.uint8) for _ in range(6)]
    contexts = [texts[i] for i in (0, 1, 0, 2, 1, 3, 0)]
    size, doc, code = np.full(7, 60), np.arange(7), np.zeros(7, np.uint32)
    plain = suffixes.decide(code, size, doc, np.concatenate(contexts), 50)
    real, calls = suffixes.mix, []

    def same(x):
        calls.append(len(x))
        return np.zeros_like(x) if len(calls) == 1 else real(x)

    monkeypatch.setattr(suffixes, "mix", same)
    again = suffixes.decide(code, size, doc, np.concatenate(contexts), 50)
    assert sorted(plain[0]) == sorted(again[0]) == [2, 4, 6] and len(calls) > 1
    assert set(zip(plain[1], plain[2])) == set(zip(again[1], again[2]))


def test_a_passage_in_every_document(spark):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    check(spark, [(i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 60))) + passage[: rng.randint(60, 400)] + str(i)) for i in range(300)])
