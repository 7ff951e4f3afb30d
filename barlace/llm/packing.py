"""Operator 3: best-fit packing of token sequences with swap-based local search.

Documents become pieces of at most ``capacity`` tokens (only longer ones are
cut).  Pieces are dealt at random into groups of bounded size; each group is
packed by itself, best fit first, longest pieces first.  Local search then
moves pieces between underfull bins, exchanges one for one or two for one,
always raising the sum of squared fills, while the free space of the other
underfull bins could still empty one.  Pieces of bins that stay underfull go
on to a further round with the leftovers of other groups, until one group is
left or a round leaves more than PROGRESS_SHARE of its pieces; then one more
round finishes every bin.  No group grows with the input; the rounds are
logarithmic in it, whatever the lengths.

Cases: null or empty text has the end token alone; a null id is kept; repeated
rows are packed each for itself; ties in length go by row order; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Pieces in a group, about.
GROUP_PIECES = 4096
#: A bin filled to this share of its capacity is finished; others go on.
FULL_SHARE = 0.995
#: A round that leaves more than this share of its pieces is followed by the last one.
PROGRESS_SHARE = 0.9
#: Bytes of text that are split into words at once.
SLICE_BYTES = 2_000_000
#: Chunks kept in a worker before it starts anew (about 300 bytes each, with their parts).
TOKEN_CACHE = 700_000
#: Words that the library encodes as one text.
LINE_WORDS = 128


# Letters that stand composed and have a lower case of one letter, and marks that never join letters or digits.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:|*#$%&]*)")


MARKS = b".,!?;:|*#$%&"


class Numbers(dict):
    """Numbers new keys in turn."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


class WordTokenizer:
    """Token ids of whole texts by a tokenizer that never joins over white space.

    Each white-space-free chunk is looked up by number.  A chunk of plain letters
    with marks behind has the ids of its lower-cased letters and those of its
    marks, which are chunks themselves; any other is encoded once.  That equals
    encoding the text at once for tokenizers that drop white space, lower-case,
    and part letters from marks before they merge; a test holds it against the
    library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.chunks = Numbers({b"": 0})
        self.pairs = np.zeros((1 << 16, 2), np.int32)  # the two chunks that make up a chunk: itself and none, or letters and marks
        self.flat, self.starts, self.sizes = np.empty(1 << 18, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) for words that are one piece each before merging."""
        lines = [b" ".join(words[k : k + LINE_WORDS]).decode() for k in range(0, len(words), LINE_WORDS)]
        ids = [found.ids for found in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32)
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not close each word with one token")
        return flat, np.diff(ends, prepend=0)

    def store(self, numbers: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.pairs[numbers, 0] = numbers
        self.used += len(ids)

    def learn(self, first: int) -> None:
        """Encodes the chunks that are numbered from ``first``."""
        fresh = list(itertools.islice(reversed(self.chunks), len(self.chunks) - first))[::-1]
        plain, other, made = [], [], []
        for chunk in fresh:  # grows by the parts of made chunks
            if (chunk.isalpha() and chunk.islower()) or not chunk.strip(MARKS):
                plain.append(chunk)
            elif m := PLAIN.fullmatch(text := chunk.decode()):
                letters = m[1].lower().encode()
                if letters == chunk:
                    plain.append(chunk)
                    continue
                for part in (letters, m[2].encode()):
                    if part not in self.chunks:
                        fresh.append(part)
                made.append((self.chunks[chunk], self.chunks[letters], self.chunks[m[2].encode()]))
            else:
                other.append((chunk, text))
        while len(self.chunks) > len(self.pairs):
            self.pairs, self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.pairs, self.starts, self.sizes))
        if plain:
            self.store([self.chunks[c] for c in plain], *self.encode_words(plain))
        if other:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.store([self.chunks[c] for c, _ in other], np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        if made:
            numbers = np.array(made, np.int32)
            self.pairs[numbers[:, 0]] = numbers[:, 1:]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.chunks) > TOKEN_CACHE:
            self.clear()
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        known = len(self.chunks)
        numbers = np.fromiter(map(self.chunks.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(counts.sum()))
        if len(self.chunks) > known:
            self.learn(known)
        parts = self.pairs[numbers].ravel()
        sizes = self.sizes[parts]
        ends = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        ids = self.flat[np.repeat(self.starts[parts] - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[2 * np.concatenate([[0], np.cumsum(counts)])]
        return [ids[i:j] for i, j in itertools.pairwise(cuts)]


@functools.cache
def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker."""
    return WordTokenizer(path)


def slices(texts: list[bytes], most: int = SLICE_BYTES):
    """Runs of texts of about ``most`` bytes together; a longer text stands alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of each document of (id, text)."""

    def run(batches):
        tokenizer = worker_tokenizer(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            ids = batch.column("id").to_pylist()
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            encoded = itertools.chain.from_iterable(map(tokenizer.encode, slices(texts)))
            for doc, tokens in zip(ids, encoded, strict=True):
                tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[start : start + capacity]
                    for column, value in zip(rows, (doc, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )
        tokenizer.clear()  # an idle worker keeps the tokenizer, not the texts' chunks

    return docs.mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the bin that it fills best."""
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some bin has room r
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[k].append(i)
            room -= size
        else:
            k, room = len(bins), capacity - size
            bins.append([i])
        by_room.setdefault(room, []).append(k)
        rooms |= 1 << room
    return bins


def _largest_transfer(give: list[int], take: list[int], lengths: list[int], most: int):
    """(net, positions given, positions returned) with the largest 0 < net <= most, or None."""
    best = None
    returned = [(0, ())] + sorted((lengths[j], (j,)) for j in take)
    sizes = [r[0] for r in returned]
    offers = [(lengths[i], (i,)) for i in give] + [(lengths[i] + lengths[j], (i, j)) for i, j in itertools.combinations(give, 2)]
    for size, given in offers:
        # the least return that brings the net down to ``most``
        k = bisect.bisect_left(sizes, size - most)
        if k < len(sizes) and (net := size - sizes[k]) > 0 and (best is None or net > best[0]):
            if len(given) == 2 and not returned[k][1]:
                continue  # two moves, found singly
            best = (net, given, returned[k][1])
            if net == most:
                break
    return best


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empties underfull bins by moves and swaps that raise the squared fill."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    under = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: fill[k])
    while under:
        source = under[0]
        targets = under[1:]
        if sum(capacity - fill[k] for k in targets) < fill[source]:
            break  # no sequence of moves can empty a bin
        moved = False
        for target in targets:
            room = capacity - fill[target]
            if not fill[source]:
                break
            if room and (found := _largest_transfer(bins[source], bins[target], lengths, min(room, fill[source]))):
                net, given, back = found
                # squared fills rise: the target is at least as full as the source
                bins[source] = [i for i in bins[source] if i not in given] + list(back)
                bins[target] = [i for i in bins[target] if i not in back] + list(given)
                fill[source] -= net
                fill[target] += net
                moved = True
        if not moved:
            # bins with the same lengths meet a part of the same targets, in vain as well
            same = sorted(lengths[i] for i in bins[source])
            under = [k for k in under if fill[k] != fill[source] or sorted(lengths[i] for i in bins[k]) != same]
        elif not fill[source]:
            under.pop(0)
        under = sorted((k for k in under if fill[k] < capacity), key=lambda k: fill[k])
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def group_packer(capacity: int, base: int, last: bool):
    """Function for one group: its pieces with a sequence, an offset there, and whether that bin is finished."""

    def run(key, table):
        lengths = table.column("length").to_pylist()
        sequence, offset, finished = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        for k, members in enumerate(pack(lengths, capacity)):
            full = last or sum(lengths[i] for i in members) >= FULL_SHARE * capacity
            at = 0
            for i in sorted(members):
                sequence[i], offset[i], finished[i] = base + (key[0].as_py() << 20) + k, at, full
                at += lengths[i]
        return (
            table.select([*NAMES, "uid"])
            .append_column("sequence_id", pa.array(sequence, pa.int64()))
            .append_column("offset", pa.array(offset, pa.int64()))
            .append_column("finished", pa.array(finished, pa.bool_()))
        )

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.keep(
        token_pieces(docs, tokenizer_path, end_id, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces"
    )
    names = [*NAMES, "sequence_id", "offset"]
    done = [
        pieces.where(F.col("length") == capacity)
        .withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
        .select(names)
    ]
    rest, turn, before = pieces.where(F.col("length") < capacity), 0, None
    while n := rest.count():
        groups = -(-n // GROUP_PIECES)
        run = group_packer(capacity, turn << 57, last=groups == 1 or (before is not None and n > PROGRESS_SHARE * before))
        packed = scratch.keep(
            rest.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
            .groupBy("grp")
            .applyInArrow(run, f"{PIECES}, uid long, sequence_id long, offset long, finished boolean"),
            f"round{turn}",
        )
        done.append(packed.where("finished").select(names))
        rest, turn, before = packed.where("not finished").select(*NAMES, "uid"), turn + 1, n
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
