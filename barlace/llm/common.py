"""Shared parts of the training-data operators: scratch tables, hashing, connectivity.

Scratch tables are Parquet files below ``spark.checkpoint.dir``, which every
executor and the driver share; a lost executor therefore never loses a cut in
the lineage.  Only where the session names no such folder (tests, a laptop) is
one set below the system's temporary folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: 0x20 and 0x09-0x0D.  ``bytes.split()`` uses exactly these.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"
#: Rows of 8-byte ids that may be broadcast after they were counted.
BROADCAST_IDS = 100_000
#: Words kept in a Python worker's cache before it starts anew.
CACHE_WORDS = 300_000
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for scratch tables, from ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _OWN_ROOTS.get(app)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _OWN_ROOTS[app] = f"file://{tempfile.mkdtemp(prefix='barlace-')}"
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables of one operator call.  ``keep`` writes and rereads; ``drop`` frees early.

    What the returned DataFrame still reads stays until the session's end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.paths = spark, {}
        self.root = f"{scratch_root(spark)}/barlace-{name}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        self.spark.conf.set(FREE_SHUFFLES, "true")  # a written table no longer needs the shuffles that led to it
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        """A kept table that is not dropped yet, with the columns of ``like``."""
        return self.spark.read.schema(like.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                _delete(self.spark, path)

    def drop_but(self, *names: str) -> None:
        """Frees all tables except the named ones."""
        self.drop(*(set(self.paths) - set(names)))

    def _at_exit(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)
        except Exception:  # the session has gone, and with it the folder's owner
            return


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; starts anew at CACHE_WORDS words, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers of the window hash, made from a rule: xxh3 of the position.
MULTIPLIERS = [np.uint64(xxhash.xxh3_64_intdigest(b"position %d" % i) | 1) for i in range(64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Final avalanche of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def windows(hashes: np.ndarray, width: int, positions: tuple[int, ...] | None = None) -> np.ndarray:
    """Hash of each window of ``width`` words, over the named positions (all by default)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for p in range(width) if positions is None else positions:
        total += hashes[p : p + n] * MULTIPLIERS[p]
    return mixed(total)


def maybe_broadcast(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Broadcast hint if a count shows at most ``limit`` rows of narrow keys; beyond it a shuffle join runs."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, comp): smallest id reachable, for each id in ``edges`` (a, b: long).

    Alternates large-star and small-star steps on edge tables until nothing
    changes, so a star or a chain of n nodes takes O(log n) rounds; no group is
    ever gathered, and the hot centre of a star only meets a map-side minimum.
    An empty edge table gives an empty result.
    """
    e = scratch.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0"
    )
    tall = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    step, was = 0, None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: neighbours above a node point to the least of its neighbourhood
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: a node's lower neighbours, and itself, point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        ).where("u <> v").distinct()
        step += 1
        e = scratch.keep(small, f"{name}-{step}")
        was, now = (was or tall(scratch.read(f"{name}-{step - 1}", e))), tall(e)
        scratch.drop(f"{name}-{step - 1}")
        was, same = now, was == now
        if same:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
            )
