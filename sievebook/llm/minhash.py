"""Near-duplicate documents by circulant MinHash, with every link confirmed on full shingle sets.

Two permutations of the 32-bit shingle universe make all signature
coordinates: the first scatters the shingles, the second is applied after a
circular shift by one more step for each coordinate. Coordinates are banded;
documents that agree on a band are compared exactly, and connected components
of the confirmed links give the groups.

Bounded work on hot groups: equal shingle sets collapse to one class before
anything is compared, every bucket is first compared with its smallest member
only (a linear number of pairs), whose set is brought to a few tasks once each
and not to every member. Members of a bucket that are still in different
components are then joined by their rarest shingles (prefix filter). A shingle
counts only at places from which two sets of their sizes can still reach the
likeness, so a template that many texts share but that makes none of them
alike forms no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import LOWER_DIGITS, SPACED, chunks, distinct_by_row, mix, row_of, shingles, span_hashes, word_spans
from .common import WIDE, all_salts, bounded, components, cut, few, heavy_keys, lookup, salted, sweep

BANDS, ROWS = 25, 5
_U = np.uint64
_SCATTER = _U(0xC2B2AE3D27D4EB4F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each row, and their bounds."""
    starts, ends = word_spans(data, offsets, SPACED)
    words = span_hashes(data, starts, ends, LOWER_DIGITS)
    n = len(offsets) - 1
    return distinct_by_row(*shingles(words, row_of(starts, offsets), n, k), n)


def signatures(items: np.ndarray, begins: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: uint32 [coordinates, rows] for non-empty rows that begin at ``begins``."""
    place = ((items * _SCATTER) >> _U(32)).astype(np.uint32)  # first permutation
    out = np.empty((coordinates, len(begins)), dtype=np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    for k in range(coordinates):
        np.subtract(place, np.uint32(k), out=x)  # circular shift
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):  # second permutation
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        np.minimum.reduceat(x, begins, out=out[k])
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """int64 [rows of the table, bands]: a hash of each band with its number."""
    bands = len(signature) // rows
    keys = np.empty((signature.shape[1], bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(signature.shape[1], b + 1, dtype=np.uint64)
        for r in range(rows):
            h = mix(h * _SCATTER + signature[b * rows + r])
        keys[:, b] = h
    return keys.view(np.int64)


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("mark", pa.int64()), ("bands", pa.list_(pa.int64()))])


def set_hashes(items: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set, as signed numbers; 0 of an empty one."""
    a, b = np.zeros(len(at) - 1, np.uint64), np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        begins = at[:-1][full]
        a[full], b[full] = np.add.reduceat(mix(items), begins), np.add.reduceat(mix(items * _SCATTER + _U(1)), begins)
    return a.view(np.int64), b.view(np.int64)


def _profiles(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                items, at = shingle_sets(data, offsets, k)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                begins = at[:-1][full]
                a, b = set_hashes(items, at)
                lists = pa.nulls(hi - lo, pa.list_(pa.int64()))
                if len(full):
                    keys = band_keys(signatures(items, begins, bands * rows), rows)
                    where = np.zeros(hi - lo + 1, np.int32)
                    where[1:] = np.cumsum(sizes > 0) * bands
                    lists = pa.ListArray.from_arrays(pa.array(where), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(a), pa.array(b), batch.column(2).slice(lo, hi - lo), lists], schema=_PROFILE)

    return run


PARITY = [f"p{i}" for i in range(16)]


def parity(items: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each row 1,024 bits, in 16 numbers: whether an even or odd count of its items hashes there.

    Two sets differ in at least as many items as they differ in bits.
    """
    out = [np.zeros(len(at) - 1, np.uint64) for _ in PARITY]
    full = np.flatnonzero(np.diff(at))
    if len(full):
        place = mix(items + _SCATTER)
        bit, lane = _U(1) << (place & _U(63)), (place >> _U(6)) & _U(15)
        for i, one in enumerate(out):
            one[full] = np.bitwise_xor.reduceat(np.where(lane == _U(i), bit, _U(0)), at[:-1][full])
    return [x.view(np.int64) for x in out]


_SETS = pa.schema([("node", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("items", pa.binary())])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                items, at = shingle_sets(data, offsets, k)
                raw = items.tobytes()
                own = pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int64)), *map(pa.array, set_hashes(items, at)), own], schema=_SETS)

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets as lists, with their parity bits."""
    for batch in batches:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        at = np.zeros(len(parts) + 1, np.int64)
        at[1:] = np.cumsum([len(x) for x in parts])
        items = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(items.view(np.int64))), *map(pa.array, parity(items, at))], names=["node", "items", *PARITY])


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_LINKS).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words lie between ASCII white space, A-Z lower-cased; a document's set is
    its distinct k-word shingles (with fewer words, the whole sequence).
    Documents with 100 * intersection >= percent * union are linked;
    component_id is the smallest id reachable, kept tells whether it is the
    document's own. Null and wordless texts have an empty set and are linked
    with nothing. A row without id takes no part: its component is null and it
    is kept. Rows that repeat an id count each by its own text. Other columns
    are not read. With the default bands a pair of likeness 0.8 that no other
    link connects is missed with a probability of 5e-5, one above it less
    often: the sets of a pair are compared only if they share a bucket.
    """
    return judged(documents, k, percent, bands, rows, id_column, text_column).select("doc_id", "n_shingles", "component_id", "kept")


def judged(documents: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """near_duplicates with the text's hash (mark) and its component as such (label; null without id or words): components of unlike texts of one id differ in it."""
    bounded(documents.sparkSession)
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    profiles = cut(marked.mapInArrow(_profiles(k, bands, rows), "doc_id long, n_shingles long, set_a long, set_b long, mark long, bands array<long>"))
    member = ["set_a", "set_b", "n_shingles"]
    takes_part = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    usable = profiles.where(takes_part)
    of_id = profiles.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*member)).alias("lo"), F.max(F.struct(*member)).alias("hi"))
    total = profiles.count()
    unlike = cut(few(of_id, total).where("lo <> hi").select("doc_id"))
    repeated = not unlike.isEmpty()
    # A node is a class of equal sets: its first id, or the hash of its set where rows of that id have unlike sets. First
    # ids come first in buckets too, which leaves less to the prefix filter than an order by hashes.
    classes = usable.groupBy(*member).agg(F.min("doc_id").alias("first"), F.count("*").alias("members")).withColumn("node", F.col("first"))
    if repeated:
        classes = classes.join(unlike.select(F.col("doc_id").alias("first"), F.lit(True).alias("several")), "first", "left").withColumn("node", F.when(F.col("several"), F.xxhash64(*member)).otherwise(F.col("first"))).drop("several")
    classes = cut(few(classes, total))
    # A class's bands: those of its first document, found again by its id, so that arrays are not aggregated.
    own = classes.select("node", F.col("first").alias("doc_id"), *member)
    nodes = usable.join(own, ["doc_id", *member]).select("node", "n_shingles", "bands").dropDuplicates(["node"])
    banded = cut(few(nodes, total).select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")))
    least = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("pivot"), F.count("*").alias("size")).where("size > 1").withColumn("weight", F.col("size"))
    least = cut(few(least, bands * total))
    buckets = cut(few(lookup(banded, least, ["key"], "weight", how="inner").select("key", "node", "n", "pivot", "size"), bands * total))

    # The one step that moves whole texts: the sets of all that share a bucket, for every comparison that follows.
    wanted = few(buckets.select("node").distinct(), total).join(classes.select("node", F.col("first").alias("doc_id")), "node")
    wanted = cut(few(wanted, total))
    wide = WIDE * wanted.count()
    schema = "node long, n_shingles long, set_a long, set_b long, items binary"
    clear = wanted.join(unlike, "doc_id", "left_anti") if repeated else wanted
    sets = few(docs.join(clear, "doc_id").dropDuplicates(["doc_id"]).select("node", "text"), WIDE * total).mapInArrow(_sets(k), schema).select("node", "items")
    if repeated:  # of an id with unlike texts, the row whose set is the class's
        unclear = wanted.join(unlike, "doc_id", "left_semi")
        several = docs.join(unclear, "doc_id", "left_semi").mapInArrow(_sets(k), schema)
        several = several.withColumn("node", F.xxhash64(*member)).join(unclear.select("node"), "node", "left_semi")
        sets = sets.unionByName(several.select("node", "items").dropDuplicates(["node"]))
    sets = few(cut(sets), wide)
    sweep(documents.sparkSession)

    close = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    pairs = buckets.select("node", "n", F.col("pivot.node").alias("other"), F.col("pivot.n").alias("m")).where(f"node <> other and {close}").select(F.col("other").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(sets, few(pairs, bands * total), percent, wide)
    sweep(documents.sparkSession)
    n_links = links.count()
    labels = cut(components(links, n_links))

    # What is left: pairs of a bucket whose ends are not yet connected. All members of such buckets are joined anew by
    # their rarest shingles, which is exact (prefix filter) and passes over what many of them share.
    known = few(buckets.join(labels, "node", "left"), bands * total).select("key", "node", "n", F.coalesce("component", "node").alias("label"))
    mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2").select("key", "size")
    mixed = cut(few(mixed, bands * total))
    unsettled = few(lookup(known, mixed, ["key"], "size", how="inner"), bands * total).groupBy("node", "n").agg(F.first("label").alias("label"))
    more = prefix_links(sets, unsettled, percent, wide)
    sweep(documents.sparkSession)
    n_more = more.count()
    if n_more:
        labels = cut(components(links.unionByName(more), n_links + n_more))

    of_class = few(classes.join(labels, "node", "left"), total).select(*member, "members", "first", F.coalesce("component", "node").alias("label"))
    lowest = few(labels.join(classes, "node"), total).groupBy(F.col("component").alias("label")).agg(F.min("first").alias("lowest"))
    of_class = few(of_class.join(few(lowest, total), "label", "left"), total)
    of_class = cut(of_class.select(*member, "members", "label", F.coalesce("lowest", "first").alias("component_id")))
    sweep(documents.sparkSession)
    columns = ["doc_id", "n_shingles", "component_id", "mark", "label"]
    alone = profiles.where(~takes_part).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "mark", F.lit(None).cast("long").alias("label"))
    judged_rows = lookup(usable, of_class, member, "members").select(*columns).unionByName(alone)
    return judged_rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "mark", "label")


def prefix_links(sets: DataFrame, nodes: DataFrame, percent: int, wide: int | None = None) -> DataFrame:
    """(a, b) confirmed links between nodes, rows of (node, n, label), that connect all of them that links of different labels can connect.

    Two sets as alike as asked share an item; take the first in a common
    order, here by the number of nodes that hold it. It stands where each set
    still has as many items as the overlap asked for: within the first
    n - ceil(n * percent / 100) + 1 of the larger set, and within the first
    m - ceil(2 * m * percent / (100 + percent)) + 1 of the smaller. The larger
    set looks only among the sizes that its place allows. First every item's
    holders are compared with its smallest node alone; then the items whose
    holders are not all connected give all their pairs.
    """
    nodes = cut(nodes)
    wide = WIDE * sets.count() if wide is None else wide
    m = WIDE * nodes.count()
    nodes = few(nodes, m)
    lists = few(sets.join(nodes, "node", "left_semi"), wide).mapInArrow(_lists, "node long, items array<long>, " + ", ".join(f"{x} long" for x in PARITY))
    lists = cut(few(lists.join(nodes, "node"), m))
    held = lists.select("node", F.explode("items").alias("item"))
    often = few(held.groupBy("item").agg(F.count("*").alias("often")).where("often > 1"), m)
    # Items of one node stand first; they are counted, not listed.
    shared = few(held.join(often, "item"), m).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "item"))).alias("shared"))
    last = F.expr(f"cast(n - ceil(n * {percent} / 100) as int)")
    placed = few(few(shared, m).join(nodes, "node"), m).withColumn("alone", (F.col("n") - F.size("shared")).cast("int"))
    placed = placed.select("node", "n", "label", F.posexplode(F.slice("shared", 1, F.greatest(last - F.col("alone") + 1, F.lit(0)))).alias("at", "one"), "alone")
    placed = cut(placed.select("node", "n", "label", (F.col("alone") + F.col("at")).cast("long").alias("place"), F.col("one.item").alias("item")))
    bits = lists.select("node", *PARITY)

    first = _prefix_pairs(placed, bits, percent, m, star=True)
    links = confirmed(sets, first, percent, wide)
    sweep(sets.sparkSession)
    n = links.count()
    if n:
        labelled = few(placed.select("node", "label").distinct(), m)
        by_label = links.join(labelled.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labelled.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        merged = components(by_label.select(F.col("x").alias("a"), F.col("y").alias("b")), n).withColumnRenamed("node", "label")
        placed = cut(few(placed.join(merged, "label", "left"), m).withColumn("label", F.coalesce("component", "label")).drop("component"))
    return links.unionByName(confirmed(sets, _prefix_pairs(placed, bits, percent, m, star=False), percent, wide))


#: Sets that look for each other are dealt by size, in classes of this ratio.
RATIO = 0.9


def _prefix_pairs(placed: DataFrame, bits: DataFrame, percent: int, m: int, star: bool) -> DataFrame:
    """(a, b) pairs of nodes of different labels that share an item at places that allow the likeness; with ``star`` only those with the smallest node of an item and class of sizes."""
    size_class = lambda x: F.floor(F.log(x.cast("double")) / math.log(1 / RATIO) + 1e-9).cast("int")
    asked = lambda n, m: F.expr(f"ceil({percent} * ({n} + {m}) / {100 + percent})")
    small = placed.where(F.expr(f"place <= n - ceil(2 * {percent} * n / {100 + percent})")).withColumn("class", size_class(F.col("n")))
    # Sizes m of the smaller set: from percent of n up to n, and such that n - place still reaches the overlap.
    most = F.least(F.col("n"), F.expr(f"floor((n - place) * {100 + percent} / {percent}) - n"))
    fewest = F.expr(f"ceil({percent} * n / 100)")
    large = placed.withColumns({"most": most, "fewest": F.greatest(fewest, F.lit(1))}).where("most >= fewest")
    large = large.select("item", "node", "n", "label", "place", F.explode(F.sequence(size_class(F.col("fewest")), size_class(F.col("most")))).alias("class"))
    # Only items and classes whose holders differ in label can add a link.
    ends = small.groupBy("item", "class").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("pivot"))
    reach = large.groupBy("item", "class").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("rows"))
    open_ = cut(few(few(ends, m).join(few(reach, m), ["item", "class"]), m).where("least(lo, l) < greatest(hi, h)").select("item", "class", "pivot", "rows"))
    heavy = heavy_keys(few(open_.groupBy("item").agg(F.sum("rows").alias("n")), m), "item", "n")
    small = few(small.join(open_.drop("rows"), ["item", "class"]), m)
    if star:
        small = small.where("node = pivot")
    small = small.select("item", "class", F.col("node").alias("other"), F.col("n").alias("m"), F.col("label").alias("other_label"), F.col("place").alias("other_place"))
    large = few(large.join(open_.select("item", "class"), ["item", "class"], "left_semi"), m)
    small = small.withColumn("salt", F.explode(all_salts(F.col("item"), heavy)))
    joined = large.withColumn("salt", salted(F.col("item"), F.col("node"), heavy)).join(small, ["item", "class", "salt"])
    fits = f"label <> other_label and node <> other and (m < n or (m = n and other < node)) and 100 * m >= {percent} * n"
    joined = few(joined.where(F.expr(fits) & (F.least(F.expr("n - place"), F.expr("m - other_place")) >= asked("n", "m"))).select("node", "n", "other", "m").distinct(), m)
    # Sets differ in at least as many items as their parity bits differ.
    theirs = bits.select(F.col("node").alias("other"), *(F.col(x).alias(f"o{x}") for x in PARITY))
    joined = few(few(joined.join(bits, "node"), m).join(theirs, "other"), m)
    apart = " + ".join(f"bit_count({x} ^ o{x})" for x in PARITY)
    alike = f"{apart} <= n + m - 2 * ceil({percent} * (n + m) / {100 + percent})"
    return joined.where(alike).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int, wide: int | None = None) -> DataFrame:
    """The (a, b) pairs whose full sets, rows of (node, items), are alike enough.

    The set of b travels with its pair; that of a, which many pairs may share,
    is brought to each of the tasks over which a's pairs are dealt. Steps that
    read all sets have tasks for these (``wide``: their number times WIDE),
    however few the pairs are; the result, written once, for the pairs.
    """
    pairs = cut(pairs)
    n = pairs.count()
    pairs, wide = few(pairs, n), WIDE * sets.count() if wide is None else wide
    heavy = heavy_keys(few(pairs.groupBy("a").agg(F.count("*").alias("n")), n), "a", "n")
    with_b = few(pairs.withColumn("salt", salted(F.col("a"), F.col("b"), heavy)).join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b"), max(wide, WIDE * n))
    of_a = few(sets.join(few(pairs.select(F.col("a").alias("node")).distinct(), n), "node", "left_semi"), wide)
    of_a = of_a.select(F.col("node").alias("a"), F.col("items").alias("x"), F.explode(all_salts(F.col("node"), heavy)).alias("salt"))
    both = few(with_b.join(of_a, ["a", "salt"]).select("a", "b", "x", "y"), WIDE * n)
    return few(cut(both.mapInArrow(_confirm(percent), "a long, b long")), n)
