"""Document fingerprints by consistent weighted sampling.

Terms are pairs of neighbouring words, weighted by their counts and hashed to
a fixed number of dimensions. For each dimension and coordinate two gamma
variables and a uniform one are drawn once; a coordinate samples the dimension
and quantised weight with the least value, so two documents agree on it with
the probability of their generalised Jaccard similarity (sum of minima over
sum of maxima of the weights).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import LOWER_DIGITS, SPACED, chunks, row_of, shingles, span_hashes, word_spans
from .common import bounded

BITS, COORDINATES, BLOCK = 17, 64, 4096


@lru_cache(maxsize=1)
def draws(bits: int = BITS, coordinates: int = COORDINATES) -> tuple[np.ndarray, ...]:
    """(r, beta, log c, value at weight 1), float32 [dimension, coordinate]; alike in every process."""
    rng = np.random.Generator(np.random.PCG64(7_140_221))
    shape = (1 << bits, coordinates)
    r = rng.standard_gamma(2.0, shape, dtype=np.float32)
    log_c = np.log(rng.standard_gamma(2.0, shape, dtype=np.float32))
    beta = rng.random(shape, dtype=np.float32)
    return r, beta, log_c, log_c - r * (1 - beta)


def signature(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """uint16 [rows, coordinates], and which rows have terms at all."""
    out, some = np.zeros((len(column), COORDINATES), np.uint16), np.zeros(len(column), bool)
    r, beta, log_c, single = draws()
    for lo, hi, data, offsets in chunks(column):
        starts, ends = word_spans(data, offsets, SPACED)
        words = span_hashes(data, starts, ends, LOWER_DIGITS)
        terms, rows = shingles(words, row_of(starts, offsets), hi - lo, 2)
        if not len(terms):
            continue
        keys = rows.astype(np.uint64) << np.uint64(BITS) | terms >> np.uint64(64 - BITS)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        weight = np.diff(np.append(first, len(keys)))
        rows, dims = (keys[first] >> np.uint64(BITS)).astype(np.int64), (keys[first] & np.uint64((1 << BITS) - 1)).astype(np.int64)
        low = np.full((hi - lo, COORDINATES), np.inf, np.float32)
        for chosen, heavy in ((weight == 1, False), (weight > 1, True)):
            own_rows, own_dims, own_weight = rows[chosen], dims[chosen], weight[chosen]
            for i in range(0, len(own_rows), BLOCK):
                d, at = own_dims[i : i + BLOCK], own_rows[i : i + BLOCK]
                if heavy:
                    rate, shift = r[d], beta[d]
                    step = np.floor(np.log(own_weight[i : i + BLOCK].astype(np.float32))[:, None] / rate + shift)
                    values = log_c[d] - rate * (step - shift + 1)
                else:
                    values = single[d]
                begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                least = np.minimum.reduceat(values, begin, axis=0)
                low[at[begin]] = np.minimum(low[at[begin]], least)
        full = np.unique(rows)
        bits = low[full].view(np.uint32)
        out[lo + full] = ((bits * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
        some[lo + full] = True
    return out, some


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Share of equal coordinates; 1 between two texts without terms, 0 between one with and one without."""
    return np.where(some_a & some_b, (a == b).mean(axis=1) if len(a) else np.zeros(0), (some_a == some_b).astype(float))


def to_hex(rows: np.ndarray, some: np.ndarray) -> list[str]:
    """256 hex digits for each row; none for a text without terms."""
    raw = rows.astype(">u2").tobytes().hex()
    width = rows.shape[1] * 4
    return [raw[i * width : (i + 1) * width] if s else "" for i, s in enumerate(some.tolist())]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each with real = 1 is compared with the row after it."""

    def result(ids: list, texts: list[str], real: list[int]) -> pa.RecordBatch:
        own = [i for i in range(len(texts) - 1) if real[i]]
        edited, sizes = [], []
        for i in own:
            n = len(texts[i])
            edited.append(texts[i][: n - n // 3] + texts[i + 1][: n // 3])
            sizes.append(n)
        a, some = signature(pa.array(texts, pa.string()))
        b, some_b = signature(pa.array(edited, pa.string()))
        at = np.array(own, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in own], pa.int64()), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()), pa.array(to_hex(a[at], some[at]), pa.string()), pa.array(to_hex(b, some_b), pa.string()),
                pa.array(likeness(a[at], b, some[at], some_b)), pa.array(likeness(a[at], a[at + 1], some[at], some[at + 1])),
            ],
            names=[x.split()[0] for x in _OUT.split(", ")],
        )

    ids: list = []
    texts: list[str] = []
    real: list[int] = []
    size = 0
    for batch in batches:
        for doc, text, flag in zip(batch.column(0), batch.column(1), batch.column(2)):
            ids.append(doc.as_py())
            texts.append(text.as_py() or "")
            real.append(flag.as_py())
            size += len(texts[-1])
            if size > 2 << 20:
                yield result(ids, texts, real)
                ids, texts, real, size = ids[-1:], texts[-1:], real[-1:], len(texts[-1])
    if texts:
        yield result(ids, texts, real)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The next document follows in descending doc_id, after the last the first;
    a null id comes last, rows with equal ids in descending order of text. The
    edited text has its last floor(n_chars / 3) code points replaced by the
    next document's first as many, or all. Equal texts have equal
    fingerprints; texts without words have an empty one. An empty table gives
    no rows; a lone document is its own next. Other columns are not read.

    Texts are shuffled once, into ranges of doc_id; one row for each range,
    the document that follows it, is added from the driver's list of ranges.
    """
    spark = bounded(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})
    spot = F.lit(len(bounds))  # 0 for the largest ids
    if bounds:
        spot = F.lit(len(bounds)) - F.aggregate(F.array(*map(F.lit, bounds)), F.lit(0), lambda s, b: s + F.when(order > b, 1).otherwise(0))
    docs = docs.withColumn("spot", spot.cast("int"))
    heads = docs.groupBy("spot").agg(F.max(order).alias("head")).orderBy("spot").collect()  # one row for each range
    if not heads:
        return spark.createDataFrame([], _OUT)
    before = {h.head: heads[i - 1].spot for i, h in enumerate(heads)}
    lowest = -(1 << 63)
    targets = spark.createDataFrame(list(before.items()), "head long, target int")
    first = docs.select(order.alias("head"), "doc_id", "text").where(order.isin([h for h in before if h != lowest]) | (F.col("doc_id").isNull() if lowest in before else F.lit(False)))
    first = first.join(F.broadcast(targets), "head").groupBy("head", "target").agg(F.max_by(F.struct("doc_id", "text"), F.coalesce("text", F.lit(""))).alias("d"))
    rows = docs.select("spot", "doc_id", "text", F.lit(1).alias("real")).unionByName(first.select(F.col("target").alias("spot"), "d.doc_id", "d.text", F.lit(0).alias("real")))
    rows = rows.repartition(n, "spot").sortWithinPartitions("spot", F.desc("real"), F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    return rows.select("doc_id", "text", "real").mapInArrow(_compare, _OUT)
