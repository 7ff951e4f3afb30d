"""Operator 4: benchmark decontamination by spaced-seed hashing.

Fixed masks pick some positions of a window of words and ignore the others, so
a window still meets its source when words at ignored positions were replaced.
Masked hashes of test items and documents are joined; around each hit the two
texts are laid over each other on the hit's diagonal and compared word by word,
substitutions allowed.  A leak is a stretch of ``span`` words (the whole item if
it is shorter) in which at least ``percent`` per cent of the words agree.

The masks are complete for the defaults: whichever two of 13 words differ, one
mask at one place avoids both (a test goes through all cases).  A shorter
stretch (a short item or ``span``) is cut into blocks, three more than the check
accepts substitutions in it, and each choice of three of them is a mask: whichever
words differ, one mask avoids them all.  Below five words items match nothing.

Test items are few by nature, yet not assumed so: they are handed to the scan
in blocks of bounded size, one pass over the documents each.  A document is
only seen by the task that reads it, so nothing is shuffled but the findings.

Cases: words are lower-cased (A-Z) and stripped of punctuation at both ends;
null or empty texts and items without words match nothing; null ids are kept as
they are; repeated rows are reported each; several leaks of one item in one
document give one row, with the words covered by all of them; extra columns are
ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, windows

#: Positions that each mask looks at.
MASKS = ((0, 1, 2, 4, 5, 7, 8), (0, 1, 3, 6, 7, 8, 9), (0, 1, 2, 4, 5, 6, 9), (0, 1, 2, 5, 7, 8, 9))
#: Words of a stretch for which the masks are complete.
COMPLETE_WORDS = 13
#: Stripped from both ends of a word.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Items with fewer words are not told from chance and match nothing.
LEAST_WORDS = 5
#: Words of test items that are handed to the scan at once.
BLOCK_WORDS = 1_000_000
#: Bits of the first, coarse look at a hash.
COARSE_BITS = 22


class PlainHashes(WordHashes):
    """Hashes of words without case and outer punctuation; a word of punctuation alone stays itself."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = WordHashes.__missing__(self, word.strip(PUNCTUATION) or word)
        return value


def item_seeds(length: int, span: int = 13, percent: int = 80) -> list[tuple[int, ...]]:
    """Masks for an item: the fixed ones, or for a short one those that avoid whatever substitutions the check accepts."""
    width = min(span, length)
    if length < LEAST_WORDS:
        return []
    if width >= COMPLETE_WORDS:
        return list(MASKS)
    wrong = width - -(-percent * width // 100)
    blocks = min(width, wrong + 3)
    cuts = [width * k // blocks for k in range(blocks + 1)]
    return [tuple(p for k in chosen for p in range(cuts[k], cuts[k + 1])) for chosen in itertools.combinations(range(blocks), blocks - wrong)]


class SeedIndex:
    """Masked hashes of a block of items, sorted, with a coarse bit table before them."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], span: int, percent: int):
        self.items, self.span, self.percent = items, span, percent
        hashes, owners, places = [], [], []
        self.seeds: set[tuple[int, ...]] = set()
        for k, (_, words) in enumerate(items):
            for mask in item_seeds(len(words), span, percent):
                found = windows(words, mask[-1] + 1, mask) ^ np.uint64(len(mask) * 64 + mask[-1])
                self.seeds.add(mask)
                hashes.append(found)
                owners.append(np.full(len(found), k))
                places.append(np.arange(len(found)))
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owners = np.concatenate(owners)[order] if owners else flat.astype(np.int64)
        self.places = np.concatenate(places)[order] if places else flat.astype(np.int64)
        self.coarse = np.zeros(1 << COARSE_BITS, bool)
        self.coarse[(flat >> np.uint64(64 - COARSE_BITS)).astype(np.int64)] = True

    def diagonals(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, document position minus item position) of all seed hits."""
        found = set()
        for mask in self.seeds:
            own = windows(words, mask[-1] + 1, mask) ^ np.uint64(len(mask) * 64 + mask[-1])
            near = np.flatnonzero(self.coarse[(own >> np.uint64(64 - COARSE_BITS)).astype(np.int64)])
            if not len(near):
                continue
            low, high = (np.searchsorted(self.hashes, own[near], side=s) for s in ("left", "right"))
            for at, i, j in zip(near[high > low], low[high > low], high[high > low], strict=True):
                found.update(zip(self.owners[i:j].tolist(), (at - self.places[i:j]).tolist(), strict=True))
        return found

    def leaks(self, words: np.ndarray):
        """(item, first word, words, words that agree) of each leaked item of a document."""
        covered = defaultdict(set)
        for k, shift in self.diagonals(words):
            item = self.items[k][1]
            first, last = max(0, -shift), min(len(item), len(words) - shift)
            agree = item[first:last] == words[first + shift : last + shift]
            width = min(self.span, len(item))
            if len(agree) < width:
                continue
            sums = np.concatenate([[0], np.cumsum(agree)])
            good = np.flatnonzero(100 * (sums[width:] - sums[:-width]) >= self.percent * width)
            for g in good:
                covered[k].update(zip(range(g + first + shift, g + first + shift + width), agree[g : g + width].tolist(), strict=True))
        for k, cells in covered.items():
            places = {p for p, _ in cells}
            yield self.items[k][0], min(places), len(places), len({p for p, same in cells if same})


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Blocks of (id, word hashes), read row by row from the table, so the driver holds one block."""
    hashes, block, size = PlainHashes(), [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        words = hashes.of((row[1] or "").encode().lower().split())
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


LEAKS = "doc_id long, item_id long, first_word long, n_words long, n_same long"


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, span: int = 13, percent: int = 80,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_same): each test item that leaked into a document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in item_blocks(benchmark, item_col, item_text_col):
        part = docs.mapInArrow(leak_scanner(spark.sparkContext.broadcast(block), span, percent), LEAKS)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], LEAKS) if out is None else out


def leak_scanner(held, span: int, percent: int):
    """mapInArrow function over (id, text) for one broadcast block of items."""

    def run(batches):
        index, cache = SeedIndex(held.value, span, percent), PlainHashes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc, text in zip(batch.column("id").to_pylist(), texts, strict=True):
                if not text:
                    continue
                for leak in index.leaks(cache.of(text.lower().split())):
                    for column, value in zip(rows, (doc, *leak), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int64()) for r in rows], ["doc_id", "item_id", "first_word", "n_words", "n_same"]
            )

    return run


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, span: int = 13, percent: int = 80, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows into which no test item leaked, with all their columns, null ids included; one pass for each block."""
    for block in item_blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(leak_filter(docs.sparkSession.sparkContext.broadcast(block), span, percent, text_col), docs.schema)
    return docs


def leak_filter(held, span: int, percent: int, text_col: str):
    """mapInArrow function that keeps the rows without a leak from one broadcast block."""

    def run(batches):
        index, cache = SeedIndex(held.value, span, percent), PlainHashes()
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            clean = [not t or next(index.leaks(cache.of(t.lower().split())), None) is None for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
