"""Packing documents into windows of fixed length by non-negative least squares.

Every document's tokens are cut into whole windows and a remainder. Only the
histogram of remainder lengths (one bin for each length under the window)
reaches the driver. Shallow combinations of lengths that fill a window exactly
are its columns; their repeat counts solve a non-negative least squares
problem, are rounded down to what the bins hold, and each document finds its
place from its rank among those of equal length. Remainders left over are
laid end to end and cut at window ends; what does not fill a last window is
cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import bounded, cut, few, sweep

WINDOW = 1024
#: In combinations of three lengths the smallest is a multiple of this.
STEP = 8
SWEEPS = 30


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file in JSON, with its added tokens. The other ids number the merges in order, so they serve as ranks."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    added = {t["content"]: t["id"] for t in given["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(letter[c] for c in token): i for token, i in given["model"]["vocab"].items() if all(c in letter for c in token) and token not in added}
    return tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def reader(path: str) -> Tokenizer:
    """The tokenizer file in the library that defines the ids."""
    return Tokenizer.from_file(path)


def token_ids(path: str, pattern: str, text: str | None) -> np.ndarray:
    """Little-endian unsigned 32-bit ids of the text, then id 0. An added token in the text is its one id."""
    try:
        ids = tokenizer(path, pattern).encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)
    except ValueError:  # tiktoken's regex gives up on runs of about a million white-space characters
        ids = np.array(reader(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids.astype("<u4"), np.zeros(1, "<u4"))


def combinations(window: int, step: int = STEP) -> list[tuple[int, ...]]:
    """All pairs, and the triples whose least length is a multiple of step, that fill the window."""
    pairs = [(a, window - a) for a in range(1, window // 2 + 1)]
    return pairs + [(a, b, window - a - b) for a in range(step, window // 3 + 1, step) for b in range(a, (window - a) // 2 + 1)]


def repeat_counts(histogram: np.ndarray, columns: list[tuple[int, ...]], sweeps: int = SWEEPS) -> list[int]:
    """Non-negative least squares by coordinate descent, rounded down within what the bins hold."""
    rest = histogram.astype(float).tolist()
    weights = [{x: c.count(x) for x in c} for c in columns]
    usable = [i for i, w in enumerate(weights) if all(histogram[x] >= n for x, n in w.items())]
    values = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for i in usable:
            w = weights[i]
            change = sum(n * rest[x] for x, n in w.items()) / sum(n * n for n in w.values())
            change = max(change, -values[i])
            if change:
                values[i] += change
                for x, n in w.items():
                    rest[x] -= n * change
                moved = max(moved, abs(change))
        if moved < 0.5:
            break
    left, counts = histogram.astype(int).tolist(), [0] * len(columns)
    for i in sorted(usable, key=lambda i: (-values[i], i)):
        counts[i] = n = min(int(values[i] + 1e-9), *(left[x] // k for x, k in weights[i].items()))
        for x, k in weights[i].items():
            left[x] -= n * k
    # Rounding leaves room: the same columns once more, as often as they still fit.
    for i in sorted(usable, key=lambda i: (len(columns[i]), i)):
        n = min(left[x] // k for x, k in weights[i].items())
        if n > 0:
            counts[i] += n
            for x, k in weights[i].items():
                left[x] -= n * k
    return counts


def layout(histogram: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int, int]:
    """(length, first rank, end rank, first sequence, offset) for combined remainders; (length, first rank, first token) for the rest; sequences used; tokens of the rest."""
    columns = combinations(window)
    taken, sequence, placed = [0] * window, 0, []
    for column, n in zip(columns, repeat_counts(histogram, columns)):
        if n:
            offset = 0
            for x in column:
                placed.append((x, taken[x], taken[x] + n, sequence, offset))
                taken[x] += n
                offset += x
            sequence += n
    rest, token = [], 0
    for x in range(window - 1, 0, -1):
        if histogram[x] > taken[x]:
            rest.append((x, taken[x], token))
            token += (int(histogram[x]) - taken[x]) * x
    return placed, rest, sequence, token


_PARTS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("part", pa.int64()), ("tokens", pa.int64()), ("rest", pa.int64()), ("rank", pa.int64()), ("whole_before", pa.int64()), ("whole_crc", pa.list_(pa.int64())), ("rest_crc", pa.int64())])


def _measure(path: str, pattern: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ranks, whole_before = [0] * window, 0
        for batch in batches:
            rows = []
            for doc, mark, text in zip(*(batch.column(i) for i in range(3))):
                ids = token_ids(path, pattern, text.as_py())
                n, raw = len(ids), memoryview(ids.tobytes())
                whole, rest = divmod(n, window)
                crc = [zlib.crc32(raw[4 * window * i : 4 * window * (i + 1)]) for i in range(whole)]
                rows.append((doc.as_py(), mark.as_py(), part, n, rest, ranks[rest], whole_before, crc, zlib.crc32(raw[4 * window * whole :])))
                ranks[rest] += 1
                whole_before += whole
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _PARTS.types)], schema=_PARTS) if rows else pa.RecordBatch.from_pylist([], schema=_PARTS)

    return run


_CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CUT_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in _CUT.split(", ")])


def _cuts(path: str, pattern: str, window: int, first: int, total: int):
    def sequence_of(token: int) -> tuple[int, int, int]:
        """(sequence, its first token, its end) that holds a token of the rest."""
        if token < total - total % window:
            return first + token // window, token - token % window, token - token % window + window
        at, number = total - total % window, total // window
        while True:
            size = 1 << ((total - at).bit_length() - 1)
            if token < at + size:
                return first + number, at, at + size
            at, number = at + size, number + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, rest, token, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                raw, at = memoryview(token_ids(path, pattern, text).tobytes()), n - rest
                while at < n:
                    number, begin, end = sequence_of(token)
                    size = min(n - at, end - token)
                    rows.append((doc, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n, number, token - begin))
                    at, token = at + size, token + size
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=_CUT_SCHEMA) if rows else pa.RecordBatch.from_pylist([], schema=_CUT_SCHEMA)

    return run


def pack(documents: DataFrame, path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are those of its whole text (null: empty) and id 0.
    Each lies in one piece; pieces of a sequence stand gapless from offset 0.
    Every sequence holds ``window`` tokens but a last few, whose sizes are
    different powers of two. Repeated rows and ids are packed row by row; a
    null id stays null; an empty table gives no rows. Other columns are not
    read.
    """
    spark = bounded(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    parts = cut(docs.mapInArrow(_measure(path, pattern, window), "doc_id long, mark long, part long, tokens long, rest long, rank long, whole_before long, whole_crc array<long>, rest_crc long"))

    # Ranks across partitions: running sums over one row for each partition and length.
    n_rows = parts.count()
    sized = parts.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.size("whole_crc")).alias("whole"))
    sized = cut(few(sized, n_rows))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sized.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
    by_part = sized.groupBy("part").agg(F.sum("whole").alias("whole"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("whole").over(every), F.lit(0)).alias("part_whole"))  # one row for each partition
    histogram, whole = np.zeros(window, np.int64), 0
    for rest, n, w in sized.groupBy("rest").agg(F.sum("n"), F.sum("whole")).collect():  # at most ``window`` rows
        histogram[rest] = n if rest else 0
        whole += w
    placed, left, used, total = layout(histogram, window)
    ranked = few(ranked.join(by_part, "part"), n_rows)
    # Read by each kind of piece below, so it is written once.
    numbered = cut(few(parts.join(ranked, ["part", "rest"]), n_rows).withColumn("place", F.col("rank") + F.col("rank_before")))
    sweep(spark)

    own = numbered.where("size(whole_crc) > 0").select("doc_id", "tokens", "whole_before", "part_whole", F.posexplode("whole_crc").alias("i", "crc"))
    pieces = own.select("doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), (F.col("part_whole") + F.col("whole_before") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # Both tables are bounded by the number of combinations, whatever the input.
    slots = spark.createDataFrame(placed, "rest long, low long, high long, first long, at long")
    rests = spark.createDataFrame(left, "rest long, low long, token long")
    remainder = numbered.where("rest > 0")
    joined = remainder.join(F.broadcast(slots), "rest").where("place >= low and place < high")
    start = (F.col("tokens") - F.col("rest")).alias("start")
    pieces = pieces.unionByName(joined.select("doc_id", start, F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), (F.lit(whole) + F.col("first") + F.col("place") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset")))

    token = F.col("token") + (F.col("place") - F.col("low")) * F.col("rest")
    over = remainder.join(F.broadcast(rests), "rest").where("place >= low").withColumn("token", token)
    fits = (F.floor(F.col("token") / window) == F.floor((F.col("token") + F.col("rest") - 1) / window)) & (F.col("token") < total - total % window)
    pieces = pieces.unionByName(over.where(fits).select("doc_id", start, F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), (F.lit(whole + used) + F.floor(F.col("token") / window)).alias("sequence_id"), (F.col("token") % window).alias("offset")))
    # A remainder that is cut is read again: at most two for each sequence of the rest.
    again = over.where(~fits).select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "tokens", "rest", "token")
    texts = docs.join(again.select("id", "of").distinct(), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), "left_semi").dropDuplicates(["doc_id", "mark"])
    cuts = again.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of"))).select("doc_id", "tokens", "rest", "token", "text")
    return pieces.unionByName(cuts.mapInArrow(_cuts(path, pattern, window, whole + used, total), _CUT))
