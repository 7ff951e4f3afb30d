"""Operator 10: exact n-gram Jaccard self-join by the size-aware heavy-light method.

A document's set is its distinct windows of ``width`` lower-cased words (the
whole sequence if shorter).  Sets up to a boundary size are *light*: they
enumerate their fixed-size subsets, of the sizes that an overlap at the
threshold needs, and two light sets that link share one.  Larger sets are
*heavy*: they scan inverted lists, of as many of their elements as a linked set
cannot avoid (the prefix under one global order).  Light sets near the boundary
stand in the lists as well, so that heavy sets find them.  The boundary is the
size at which enumeration costs more than list scans, from counts by size.

The global order puts frequent elements last.  It is any fixed order for the
result; a document sample only decides which elements are called frequent.

Bucket hits are verified by exact set overlaps (see ``linking``).  Equal sets
are one class from the start, so copies are never paired.

Cases: null text counts as empty; a set without words is empty and links with
nothing; null ids stay in the result with a null component; rows that repeat an
id are one node of the graph, each with its own set; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, connected_components, maybe_broadcast, mixed, windows
from .linking import link

#: Sets beyond this size are never light: their subsets are too many at any cost.
MOST_LIGHT = 16
#: One document in so many is used to tell which shingles are frequent.
ORDER_SAMPLE = 16
#: A shingle met so often in that sample counts as frequent.
ORDER_COUNT = 3
#: Bits of the table of frequent shingles, at least and at most (16 MB).
ORDER_BITS = (16, 27)


def shingle_hashes(text: bytes | None, cache: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows of a text."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = cache.of(words)
    if len(words) < width:
        return mixed(windows(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(windows(hashes, width))


def partner_sizes(s: int, percent: int) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def overlap_needed(s: int, t: int, percent: int) -> int:
    """Least c with 100 c >= percent (s + t - c)."""
    return -(-percent * (s + t) // (100 + percent))


def subset_sizes(s: int, boundary: int, percent: int) -> list[int]:
    """Subset sizes that a light set of size s shares with some light partner."""
    return sorted({overlap_needed(s, t, percent) for t in partner_sizes(s, percent) if 0 < t <= boundary})


def prefix_length(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1


def subset_count(s: int, boundary: int, percent: int) -> int:
    return sum(math.comb(s, c) for c in subset_sizes(s, boundary, percent))


def choose_boundary(by_size: list[tuple[int, int, float]], percent: int) -> int:
    """Boundary of least cost from (size, documents, mean length of the lists in its prefix)."""
    costs = []
    for boundary in range(MOST_LIGHT + 1):
        light = sum(n * subset_count(s, boundary, percent) for s, n, _ in by_size if s <= boundary)
        costs.append(light + sum(n * prefix_length(s, percent) * length for s, n, length in by_size if s > boundary))
    return int(np.argmin(costs))


def bucket_keys(hashes: np.ndarray, boundary: int, percent: int, late: np.ndarray, shift: int) -> np.ndarray:
    """Keys under which a set meets every set it may link with: even ones are
    elements, each at its place in the order; odd ones, behind them, are subsets."""
    n = len(hashes)
    if not n:
        return hashes
    keys = []
    if n > boundary or n >= -(-percent * (boundary + 1) // 100):
        is_late = late[(hashes >> np.uint64(shift)).astype(np.int64)]
        order = np.concatenate([hashes[~is_late], hashes[is_late]])
        keys.append(order[: prefix_length(n, percent)] & ~np.uint64(1))
    if n <= boundary:
        for c in subset_sizes(n, boundary, percent):
            chosen = np.array(list(itertools.combinations(range(n), c)))
            sums = mixed(hashes)[chosen].sum(axis=1, dtype=np.uint64) + np.uint64(c)
            keys.append(mixed(sums) | np.uint64(1))
    return np.concatenate(keys)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(flat))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def shingle_rows(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, h): one row for each distinct shingle of a document."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t, cache, width) for t in _texts(batch)]
            sizes = np.array([len(s) for s in sets], np.int64)
            ids = np.repeat(np.arange(len(sets)), sizes)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(ids)), pa.array(np.repeat(sizes, sizes)), _signed(flat)], ["id", "n", "h"]
            )

    return docs.mapInArrow(run, "id long, n long, h long")


def frequent_table(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> tuple[np.ndarray, int, int]:
    """(table of frequent hashes, shift from a hash to its place there, boundary size).

    The table has a fixed largest size; a hash that meets another's place merely
    counts as frequent too.  None of this changes the result, only bucket sizes.
    """
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(ORDER_SAMPLE)) == 0)
    rows = scratch.keep(shingle_rows(sample, width), "sample")
    often = scratch.keep(rows.groupBy("h").count().where(F.col("count") >= ORDER_COUNT), "often")
    total = often.count()
    bits = min(max(ORDER_BITS[0], (16 * total).bit_length()), ORDER_BITS[1])
    shift = 64 - bits
    words = often.groupBy(F.shiftrightunsigned("h", shift + 6).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {shift}) & 63 as int)))").alias("bits")
    ).toPandas()  # at most 2^(bits - 6) rows
    packed = np.zeros(1 << (bits - 6), np.int64)
    packed[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    table = np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)
    small = rows.where(F.col("n") <= MOST_LIGHT)
    lists = (
        small.join(often, "h", "left")
        .groupBy("n")
        .agg(F.count_distinct("id").alias("docs"), F.avg(F.lit(1.0) + ORDER_SAMPLE * (F.coalesce("count", F.lit(1)) - 1)).alias("length"))
        .collect()  # one row for each size up to MOST_LIGHT
    )
    boundary = choose_boundary([(int(r["n"]), r["docs"] * ORDER_SAMPLE, float(r["length"])) for r in lists], percent)
    scratch.drop("sample", "often")
    return table, shift, boundary


def bucket_table(docs: DataFrame, width: int, percent: int, order: tuple[np.ndarray, int, int]) -> DataFrame:
    """(id, n, h1, h2, keys): set size, 128-bit hash of the set, bucket keys."""
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(order[0]))
    shift, boundary = order[1:]

    def run(batches):
        cache, late = WordHashes(), np.unpackbits(held.value).astype(bool)
        for batch in batches:
            sizes, high, low, keys = [], [], [], []
            for text in _texts(batch):
                hashes = shingle_hashes(text, cache, width)
                sizes.append(len(hashes))
                digest = xxhash.xxh3_128_digest(hashes.tobytes())
                high.append(digest[:8])
                low.append(digest[8:])
                keys.append(bucket_keys(hashes, boundary, percent, late, shift))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), *(pa.array(np.frombuffer(b"".join(x), np.int64)) for x in (high, low)), _lists(keys)],
                ["id", "n", "h1", "h2", "keys"],
            )

    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long, keys array<long>")


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """(id, members): the sorted hashes of each document's set."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t, cache, width) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(sets)], ["id", "members"])

    return docs.mapInArrow(run, "id long, members array<long>")


def likely(pairs: DataFrame, shared: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Pairs whose common prefix elements allow the overlap they need; light sets pass.

    Let the prefix of x end first.  Common elements up to its end stand in both
    prefixes, and beyond it x has only its other elements, so the overlap is at
    most the common prefix elements plus those.
    """
    keys = lambda side: shared.select(F.col("id").alias(side), F.expr("filter(keys, k -> k & 1 = 0)").alias(f"k{side}"), F.col("n").alias(f"n{side}"))
    least = f"ceil({percent} * cast(na + nb as long) / {100 + percent})"
    beyond = f"(ceil({percent} * cast(greatest(na, nb) as long) / 100) - 1)"
    return (
        pairs.join(keys("a"), "a")
        .join(keys("b"), "b")
        .where(f"least(na, nb) <= {boundary} or size(array_intersect(ka, kb)) >= {least} - {beyond}")
        .select("a", "b")
    )


def overlapping(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids whose sets reach the threshold."""
    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b"
    ).select("a", "b", "ma", "mb")

    def run(batches):
        for batch in batches:
            sides = []
            for name in ("ma", "mb"):
                column = batch.column(name)
                flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
                sides.append([flat[i:j] for i, j in itertools.pairwise(ends)])
            keep = []
            for x, y in zip(*sides, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; linked rows share the smallest reachable id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = frequent_table(docs, width, percent, scratch)
    table = scratch.keep(bucket_table(docs, width, percent, order), "table")
    # class of equal sets: represented by its smallest id
    classes = scratch.keep(
        table.where("id is not null and n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("most")), "classes"
    )
    rows = (
        table.where("id is not null and n > 0")
        .join(classes.select("h1", "h2", F.col("rep").alias("id")), ["id", "h1", "h2"], "left_semi")
        .select(F.posexplode("keys").alias("pos", "key"), "id", F.col("n").cast("int").alias("n"))
        .select("key", "id", F.expr("struct(n, if(key & 1 = 1, 0, pos) as pos)").alias("w"))
    )
    many = scratch.keep(
        rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key"), "many"
    )
    buckets = scratch.keep(rows.join(maybe_broadcast(many), "key", "left_semi"), "buckets")
    shared = scratch.keep(buckets.groupBy("id").agg(F.collect_set("key").alias("keys"), F.max("w.n").alias("n")), "shared")  # at most a prefix each

    def verify(pairs: DataFrame) -> DataFrame:
        near = scratch.keep(likely(pairs, shared, order[2], percent), "likely")
        wanted = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
        wanted = scratch.keep(wanted, "wanted")
        sets = scratch.keep(set_table(docs.join(maybe_broadcast(wanted), "id", "left_semi"), width), "sets")
        found = scratch.keep(overlapping(near, sets, percent).distinct(), "found")
        scratch.drop("likely", "wanted", "sets")
        return found

    # sizes must agree; at the first common element, what follows in either set must suffice for the overlap
    need = f"ceil({percent} * cast(wa.n + wb.n as long) / {100 + percent})"
    fits = f"100L * least(wa.n, wb.n) >= {percent} * greatest(wa.n, wb.n) and least(wa.n - wa.pos, wb.n - wb.pos) >= {need}"
    comps = link(buckets, verify, scratch, fits)
    # a repeated id ties the classes of its rows together
    twice = table.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    tied = scratch.keep(
        table.where("n > 0").join(twice, "id").join(classes, ["h1", "h2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")),
        "tied",
    )
    if not tied.isEmpty():
        known = tied if comps is None else tied.unionByName(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        comps = connected_components(known, scratch, "tied-cc")
    ties = classes.where("rep < most").select("h1", "h2", "rep")
    out = table.select("id", "n", "h1", "h2")
    named = out.join(ties, ["h1", "h2"], "left").withColumn(
        "node", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id"))
    )
    if comps is not None:
        named = named.join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    else:
        named = named.withColumn("comp", F.col("node"))
    out = scratch.keep(
        named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("comp")).alias("component_id")), "out"
    )
    scratch.drop_but("out")  # three numbers a document stay, the bucket keys go
    return out
