"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Every run of ``threshold`` symbols (bytes or words) that also starts in a
document with a smaller id is removed. Suffixes are sorted only through
``threshold`` symbols, by most-significant-digit passes; after each pass,
groups that one text has alone are dropped, and the groups left after the last
pass are exactly the repeated windows.

The first pass is not over all suffixes. Its digit has a place chosen by
content: of the 31 (for 50 symbols) grams of 20 symbols that start in a window,
the one with the least hash. Equal windows have equal such grams at equal
places, so it is enough to group the texts by the hashes of these grams, one
in sixteen positions. Windows of grams that only one text has are dropped
there. The others are sent with their symbols to the task of their gram. There
whole contexts (the windows around one gram) that are equal symbol by symbol
are settled at once; what is left goes through radix passes of eight symbols
each. Copies of a whole text are told by their SHA-256 and are settled before
all that.

Rows that are shuffled are blobs of many records, so the work inside a task is
on whole arrays. The number of buckets follows spark.sql.shuffle.partitions and
the bytes of the texts. A task takes one bucket at a time into memory; a gram
that very many texts have stays in one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import DIGITS, SPACED, chunks, mix, powers, row_of, span_hashes, word_spans
from .common import bounded, cut, lookup, sweep

_U = np.uint64
_TOP = np.uint32(0xFFFFFFFF)


def symbols(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(a 64-bit number for each symbol, bounds of each row, starts and ends in bytes unless symbols are bytes)."""
    if unit == "byte":
        return DIGITS[data], offsets, None, None
    starts, ends = word_spans(data, offsets, SPACED)
    return span_hashes(data, starts, ends, DIGITS), np.searchsorted(row_of(starts, offsets), np.arange(len(offsets))), starts, ends


def slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of ``width``; as many fewer at the end."""
    step, f = 1, np.minimum if least else np.maximum
    while 2 * step <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors(values: np.ndarray, bounds: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """(positions of anchors, hash of the gram at every position, its order, least order of each window or 0 where none starts)."""
    n = len(values)
    if n < threshold:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint32), z.astype(np.uint32)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    m = n - gram + 1
    hashes = total[gram:] - total[:m]
    hashes *= down[:m]
    hashes = mix(hashes)
    order = (hashes >> _U(32)).astype(np.uint32)
    order[order == 0] = 1
    width = threshold - gram + 1
    least = slide(order, width, True)
    # Windows that would run past the end of their row.
    for end in bounds[1:-1].tolist():
        least[max(0, end - threshold + 1) : end] = 0
    begin = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    chosen = np.flatnonzero(slide(begin, width, False)[:m] == order)
    return chosen, hashes, order, least


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes * _U(0xC2B2AE3D27D4EB4F)) >> _U(33)) % _U(buckets)


def planes(x: np.ndarray) -> bytes:
    """uint32 in two planes of 16 bits, as the upper one compresses well."""
    x = x.astype(np.uint32)
    return (x & np.uint32(0xFFFF)).astype("<u2").tobytes() + (x >> np.uint32(16)).astype("<u2").tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    half = np.frombuffer(raw, "<u2").reshape(2, -1).astype(np.uint32)
    return half[0] | half[1] << np.uint32(16)


def squeezed(symbols: np.ndarray, unit: str) -> bytes:
    """Symbols of contexts as they are shuffled; bytes are texts, which zstd makes smaller than the shuffle's own codec does."""
    return zstandard.ZstdCompressor(level=1).compress(symbols.tobytes()) if unit == "byte" else symbols.tobytes()


def unsqueezed(blobs: list[bytes], unit: str) -> np.ndarray:
    if unit != "byte":
        return np.frombuffer(b"".join(blobs), "<u8")
    open_ = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(map(open_.decompress, blobs)), np.uint8)


def deal(bucket: np.ndarray, owner: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes, bytes, bytes]]:
    """Split records, in order of owner, by bucket: (bucket, their places, ids, marks and record counts of the owners)."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_bucket[1:] != sorted_bucket[:-1]])) if len(order) else []
    for a, b in zip(starts, [*starts[1:], len(order)]):
        at = order[a:b]
        own = owner[at]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield int(sorted_bucket[a]), at, ids[own[first]].tobytes(), marks[own[first]].tobytes(), np.diff(np.append(first, len(own))).astype("<u4").tobytes()


_BLOB = "bucket int, ids binary, marks binary, counts binary, places binary, a binary, b binary"
_NAMES = [x.split()[0] for x in _BLOB.split(", ")]
_BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in _NAMES[1:])])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _BLOB_SCHEMA)], schema=_BLOB_SCHEMA)


def _find(threshold: int, gram: int, buckets: int, unit: str):
    """Anchors of every text, by bucket of their gram: places and low hash bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in chunks(batch.column(2)):
                values, bounds, _, _ = symbols(data, offsets, unit)
                chosen, hashes, _, _ = anchors(values, bounds, threshold, gram)
                if not len(chosen):
                    continue
                own, code = row_of(chosen, bounds), hashes[chosen]
                places = (chosen - bounds[own]).astype(np.uint32)
                yield _batch([(k, i, m, c, planes(places[at]), (code[at] & _U(0xFFFFFFFF)).astype("<u4").tobytes(), b"") for k, at, i, m, c in deal(bucket_of(code, buckets), own, ids[lo:hi], marks[lo:hi])])

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each bucket, from rows that come in order of bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != held[0]["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def owners(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and marks of the owners, and the owner of each record."""
    ids, marks = np.frombuffer(b"".join(r["ids"] for r in rows), "<i8"), np.frombuffer(b"".join(r["marks"] for r in rows), "<i8")
    return ids, marks, np.repeat(np.arange(len(ids)), np.frombuffer(b"".join(r["counts"] for r in rows), "<u4"))


_PLACES = "doc_id long, mark long, places binary"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: of the anchors of a bucket those whose gram several texts have, by text; of equal texts the smallest id stands for all."""
    for rows in by_bucket(batches):
        ids, marks, own = owners(rows)
        code = np.frombuffer(b"".join(r["a"] for r in rows), "<u4")
        places = np.concatenate([unplanes(r["places"]) for r in rows])
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        size = np.diff(np.append(first, len(order)))
        mark = marks[own[order]]
        several = np.repeat(np.minimum.reduceat(mark, first) < np.maximum.reduceat(mark, first), size)
        order, code, mark = order[several], code[several], mark[several]
        if not len(order):
            continue
        again = np.lexsort((ids[own[order]], mark, code))
        order, code, mark = order[again], code[again], mark[again]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (mark[1:] != mark[:-1])]))
        who = ids[own[order]]
        keep = np.sort(order[who == np.repeat(who[first], np.diff(np.append(first, len(who))))])
        own, places = own[keep], places[keep]
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        blobs = [planes(places[a:b]) for a, b in zip(edge, [*edge[1:], len(own)])]
        yield pa.RecordBatch.from_arrays([pa.array(ids[own[edge]]), pa.array(marks[own[edge]]), pa.array(blobs, pa.binary())], names=["doc_id", "mark", "places"])


def _contexts(threshold: int, gram: int, buckets: int, unit: str):
    """From texts and the places of their shared anchors: the windows of these, by bucket of their gram."""
    width = threshold - gram + 1

    def flush(group: list[tuple[int, int, str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, marks = np.array([g[0] for g in group], "<i8"), np.array([g[1] for g in group], "<i8")
        for lo, hi, data, offsets in chunks(pa.array([g[2] for g in group], pa.string())):
            values, bounds, _, _ = symbols(data, offsets, unit)
            _, hashes, order, least = anchors(values, bounds, threshold, gram)
            found = [g[3].astype(np.int64) + bounds[i] for i, g in enumerate(group[lo:hi])]
            own = np.repeat(np.arange(hi - lo), [len(x) for x in found])
            at = np.concatenate(found) if found else np.zeros(0, np.int64)
            if not len(at):
                continue
            start = at[:, None] - np.arange(width - 1, -1, -1)
            fits = (start >= 0) & (start < len(least))
            fits &= least[np.clip(start, 0, len(least) - 1)] == order[at][:, None]
            begin, count = at - (width - 1) + fits.argmax(axis=1), fits.sum(axis=1)
            some = count > 0
            own, at, begin, count = own[some], at[some], begin[some], count[some]
            raw = data if unit == "byte" else values
            out = []
            for k, sel, i, m, c in deal(bucket_of(hashes[at], buckets), own, ids[lo:hi], marks[lo:hi]):
                size = count[sel] + threshold - 1
                where = np.repeat(begin[sel] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                codes = (hashes[at[sel]] & _U(0xFFFFFFFF)).astype("<u4")
                out.append((k, i, m, c, planes((begin - bounds[own])[sel]), count[sel].astype("<u2").tobytes() + codes.tobytes(), squeezed(raw[where], unit)))
            if out:
                yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            for doc, mark, text, places in zip(*(batch.column(i) for i in range(4))):
                group.append((doc.as_py(), mark.as_py(), text.as_py(), np.sort(np.concatenate([unplanes(x) for x in places.as_py()]))))
                size += len(group[-1][2])
                if size > 1 << 20:
                    yield from flush(group)
                    group, size = [], 0
        yield from flush(group)

    return run


def repeated(digits: np.ndarray, start: np.ndarray, doc: np.ndarray, steps: list[int]) -> np.ndarray:
    """Places in ``start`` of the windows that a smaller doc has too, by radix passes on digits[start + step]."""
    live, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for n, step in enumerate(steps):
        if not len(live):
            break
        key = digits[start[live] + step]
        order = np.lexsort((key, group)) if n else np.argsort(key)
        live, group, key = live[order], group[order], key[order]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(fresh)
        owner = doc[live]
        low = np.minimum.reduceat(owner, first)
        several = low < np.maximum.reduceat(owner, first)
        size = np.diff(np.append(first, len(live)))
        keep = np.repeat(several, size)
        group = np.repeat(np.arange(int(several.sum())), size[several])
        least = np.repeat(low, size)[keep]
        live = live[keep]
    return np.sort(live[doc[live] > least]) if len(live) else live


_RANGES = "doc_id long, mark long, ranges binary"


#: Symbols of contexts that a task expands at a time; bytes of texts for each bucket, if shuffle partitions are fewer.
PART, PER_BUCKET = 1_000_000, 64 << 20


def decide(code: np.ndarray, size: np.ndarray, doc: np.ndarray, raw: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that a smaller doc has as a whole; (context, window in it) of the windows of others that a smaller doc has too; contexts, of ``size`` symbols each, lie one after the other in raw.

    Of contexts that are equal within a doc one is compared. They are
    expanded to their windows, if their gram has contexts of several docs.
    """
    base, content = np.cumsum(size) - size, np.empty(len(size), np.uint64)
    for lo, hi in _slices(size):
        part = raw[base[lo] : base[hi - 1] + size[hi - 1]]
        at = base[lo:hi] - base[lo]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((DIGITS[part] if part.dtype == np.uint8 else part) * up[: len(part)], out=total[1:])
        content[lo:hi] = mix((total[at + size[lo:hi]] - total[at]) * down[at] + size[lo:hi].astype(np.uint64))
    while True:
        order = np.lexsort((doc, content, code))
        c, h, d = code[order], content[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])]))
        members = np.diff(np.append(first, len(d)))
        unlike = _unlike(raw, base, size, order, np.repeat(order[first], members))
        if not len(unlike):
            break
        content[unlike] = mix(content[unlike] + _U(1))  # symbols differ under one hash
    whole = d > np.repeat(d[first], members)
    copies, count = order[whole], size - threshold + 1
    gone = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # One context stands for all equal ones of its document.
    alike = members - np.add.reduceat(whole.astype(np.int64), first)
    c, d = c[first], d[first]
    gram = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    several = np.repeat(np.minimum.reduceat(d, gram) < np.maximum.reduceat(d, gram), np.diff(np.append(gram, len(c))))
    rest, c = np.flatnonzero(several), c[several]
    parts = 1 + int(size[order[first[rest]]].sum()) // PART
    part_of = (c >> np.uint32(8)) % np.uint32(parts)
    for k in range(parts):
        group = rest[part_of == k]
        if not len(group):
            continue
        own = order[first[group]]
        length, windows = size[own], count[own]
        part = raw[np.repeat(base[own], length) + _counted(length)]
        if part.dtype == np.uint8:
            digits = part.astype(np.uint64)
            for bits in (8, 16, 32):
                digits = (digits[: -(bits // 8)] << _U(bits)) | digits[bits // 8 :]
        else:
            digits = part
            for step in (1, 2, 4):
                digits = mix(digits[:-step] * _U(0xC2B2AE3D27D4EB4F) + digits[step:])
        context, inside = np.repeat(np.arange(len(group)), windows), _counted(windows)
        found = repeated(digits, (np.cumsum(length) - length)[context] + inside, doc[own][context], [*range(0, threshold - 8, 8), threshold - 8])
        times = alike[group[context[found]]]
        gone[0].append(order[np.repeat(first[group[context[found]]], times) + _counted(times)])
        gone[1].append(np.repeat(inside[found], times))
    return copies, np.concatenate(gone[0]), np.concatenate(gone[1])


def _unlike(raw: np.ndarray, base: np.ndarray, size: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Those of the contexts ``own`` that do not have the symbols of ``other``, place by place."""
    out = [own[size[own] != size[other]]]
    pair = (size[own] == size[other]) & (own != other)
    own, other = own[pair], other[pair]
    for lo, hi in _slices(size[own]):
        length = size[own[lo:hi]]
        inside = _counted(length)
        differ = raw[np.repeat(base[own[lo:hi]], length) + inside] != raw[np.repeat(base[other[lo:hi]], length) + inside]
        if differ.any():
            out.append(own[lo:hi][np.bincount(np.repeat(np.arange(hi - lo), length), weights=differ, minlength=hi - lo) > 0])
    return np.concatenate(out)


def _slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of contexts of at most PART symbols, or one."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, "right")))
        yield lo, hi
        lo = hi


def _counted(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... below each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


_RANGES = "doc_id long, mark long, ranges binary"


def _decide(threshold: int, unit: str):
    """The further passes over the contexts of a bucket, some grams at a time; gives the ranges of symbols to remove by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            ids, marks, own = owners(rows)
            places = np.concatenate([unplanes(r["places"]) for r in rows]).astype(np.int64)
            size = np.concatenate([np.frombuffer(r["a"], "<u2", len(r["a"]) // 6) for r in rows]).astype(np.int64) + threshold - 1
            code = np.concatenate([np.frombuffer(r["a"][len(r["a"]) // 3 :], "<u4") for r in rows])
            raw = unsqueezed([r["b"] for r in rows], unit)
            rows.clear()
            copies, context, inside = decide(code, size, ids[own], raw, threshold)
            del raw
            who, spot = own[context], places[context] + inside
            order = np.lexsort((spot, who))
            who, spot = who[order], spot[order]
            edge = np.flatnonzero(np.concatenate([[len(who) > 0], (who[1:] != who[:-1]) | (spot[1:] > spot[:-1] + 1)])) if len(who) else np.zeros(0, np.int64)
            last = np.append(edge[1:], len(who))[: len(edge)] - 1
            owner = np.concatenate([who[edge], own[copies]])
            pairs = np.stack([np.concatenate([spot[edge], places[copies]]), np.concatenate([spot[last] + threshold, places[copies] + size[copies]])], axis=1).astype("<u4")
            if not len(owner):
                continue
            order = np.argsort(owner, kind="stable")
            owner, pairs = owner[order], pairs[order]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            ends = np.append(first[1:], len(owner))
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner[first]]), pa.array(marks[owner[first]]), pa.array([pairs[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], names=["doc_id", "mark", "ranges"])

    return run


def union(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of (start, end) ranges."""
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))].astype(np.int64)
    reach = np.maximum.accumulate(ranges[:, 1])
    fresh = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    return ranges[fresh, 0], reach[np.append(np.flatnonzero(fresh)[1:], len(ranges)) - 1]


_CUT = "doc_id long, mark long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(unit: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, mark, text, blobs in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                a, b = union(np.frombuffer(b"".join(blobs.as_py()), "<u4").reshape(-1, 2))
                if unit != "byte":
                    _, _, starts, ends = symbols(data, np.array([0, len(data)]), unit)
                    a, b = starts[a], ends[b - 1]
                edge = np.zeros(len(data) + 1, np.int8)
                edge[a] += 1
                edge[b] -= 1
                kept = data[np.cumsum(edge[:-1]) == 0].tobytes()
                out.append((doc.as_py(), mark.as_py(), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=[x.split()[0] for x in _CUT.split(", ")])

    return run


def _prepared(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sha", F.sha2("text", 256)).withColumn("mark", F.xxhash64("sha"))


def _firsts(slim: DataFrame) -> DataFrame:
    """sha, the smallest doc_id that has it, and n, the number of rows, of texts in several rows."""
    return cut(slim.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))


def removals(docs: DataFrame, threshold: int, unit: str, with_text: bool) -> DataFrame:
    """doc_id, mark, n_removed, n_spans, kept_sha256, kept of the texts that lose symbols to unequal texts with smaller ids."""
    spark = bounded(docs.sparkSession)
    gram = max(8, threshold * 2 // 5)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // PER_BUCKET)
    usable = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= threshold)).select("doc_id", "mark", "text")
    found = usable.mapInArrow(_find(threshold, gram, buckets, unit), _BLOB)
    shared = cut(found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, _PLACES))
    sweep(spark)
    places = shared.groupBy("doc_id", "mark").agg(F.collect_list("places").alias("places"))
    # Texts meet their anchors and, later in the same plan, their ranges on the same key: they are shuffled once, and the exchange is used twice.
    contexts = usable.join(places.hint("shuffle_merge"), ["doc_id", "mark"]).select("doc_id", "mark", "text", "places").mapInArrow(_contexts(threshold, gram, buckets, unit), _BLOB)
    ranges = contexts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_decide(threshold, unit), _RANGES)
    by_text = ranges.groupBy("doc_id", "mark").agg(F.collect_list("ranges").alias("ranges"))
    return usable.join(by_text.hint("shuffle_merge"), ["doc_id", "mark"]).select("doc_id", "mark", "text", "ranges").mapInArrow(_remove(unit, with_text), _CUT)


def remove_repeats(documents: DataFrame, threshold: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, as UTF-8 bytes (null: empty).

    A byte goes if a string of ``threshold`` bytes over it also starts in a
    document with a smaller id, judged on the input; overlaps count. Rows of
    one id do not remove from each other. A row without id loses nothing and
    removes nothing. An empty table gives no rows; other columns are not read.
    """
    docs = _prepared(documents)
    slim = docs.select("doc_id", "mark", "sha", F.octet_length("text").cast("long").alias("n_bytes"))
    first = _firsts(slim)
    cuts = removals(docs, threshold, "byte", False).dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", "n_removed", "n_spans", F.col("kept_sha256").alias("kept"))
    rows = lookup(slim, first, ["sha"], "n").join(cuts, ["doc_id", "mark"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= threshold)
    return rows.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame, threshold: int = 50) -> DataFrame:
    """The documents with every passage of at least ``threshold`` words removed that also stands in a document with a smaller id.

    Words lie between ASCII white space and are compared as they are. Bytes
    from a removed run's first word to its last go; other columns and all rows
    stay. Copies of a text with a smaller id lose all their words, if these
    are as many as the threshold.
    """
    docs = _prepared(documents)
    cuts = removals(docs, threshold, "word", True).select("doc_id", "mark", F.decode("kept", "UTF-8").alias("kept"))
    words = F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    slim = docs.where("doc_id is not null").select("doc_id", "mark", "sha", words.alias("words"))
    slim = slim.where(F.col("words") >= threshold)
    copies = lookup(slim, _firsts(slim), ["sha"], "n", how="inner").where("doc_id > first").select("doc_id", "mark", F.lit(None).cast("string").alias("kept"))
    changed = cuts.unionByName(copies).groupBy("doc_id", "mark").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("kept").alias("__kept"), F.lit(True).alias("__changed"))
    mark = F.xxhash64(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    rows = documents.withColumn("__own", mark).join(changed, (F.col("doc_id") == F.col("__id")) & (F.col("__own") == F.col("__mark")), "left")
    # Of a copy only the white space around its words stays.
    edges = F.regexp_replace("text", r"(?s)[^ \t\n\x0B\f\r](?:.*[^ \t\n\x0B\f\r])?", "")
    text = F.when(F.col("__changed"), F.coalesce("__kept", edges)).otherwise(F.col("text"))
    return rows.select(*(text.alias("text") if n == "text" else F.col(n) for n in documents.columns))
