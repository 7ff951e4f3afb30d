"""Operator 1: token counts of sections by offset-mapped attribution.

A whole document is encoded once.  Token character spans come from the bytes
that each token stands for, and an interval join lays them over the spans of
sections.  A section is a line with its line break; sections tile the text.  A
token that crosses a boundary goes by one of these rules:

* ``first``: to the section that holds its first character (the default);
* ``largest``: to the section that holds most of its characters, the earlier on
  a tie;
* ``share``: in parts, by the share of its characters in each section.

Spans are kept in bytes, so a token that begins or ends inside a character is
attributed exactly; section bounds are given in code points.

Cases: null or empty text has no section and gives no row; null ids are kept;
repeated rows are counted each; empty lines are sections that hold their line
break; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "largest", "share")


class ByteTokenizer:
    """Byte-level BPE of whole texts, with the length in bytes of each token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))

    def bounds(self, text: str) -> np.ndarray:
        """Byte offsets at which tokens begin, and the text's end."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])


def attribute(bounds: np.ndarray, sections: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section.  ``bounds``: token starts and the end; ``sections``: section starts and the end, in the same units."""
    n = len(sections) - 1
    starts, ends = bounds[:-1], bounds[1:]
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends, "left") - 1
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float)
    counts = np.bincount(first[first == last], minlength=n).astype(float)
    for k in np.flatnonzero(first != last):  # tokens that cross a boundary
        own = np.arange(first[k], last[k] + 1)
        inside = np.minimum(sections[own + 1], ends[k]) - np.maximum(sections[own], starts[k])
        if rule == "largest":
            counts[own[inside.argmax()]] += 1
        else:
            counts[own] += inside / (ends[k] - starts[k])
    return counts


def section_bounds(raw: bytes) -> np.ndarray:
    """Byte offsets of the starts of lines, and the end."""
    codes = np.frombuffer(raw, np.uint8)
    starts = np.flatnonzero(codes == 10) + 1
    return np.concatenate([[0], starts[starts < len(codes)], [len(codes)]])


RESULT = "doc_id long, section long, start long, end long, n_tokens double"


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens) for each line of each document."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        tokenizer = ByteTokenizer(tokenizer_path, pattern)
        for batch in batches:
            ids, parts = batch.column("id"), []
            for k, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                if not raw:
                    continue
                text = raw.decode()
                sections = section_bounds(raw)
                counts = attribute(tokenizer.bounds(text), sections, rule)
                if len(text) == len(raw):
                    points = sections
                else:  # code points before each byte offset
                    heads = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                    points = heads[sections]
                parts.append((np.full(len(counts), k), np.arange(len(counts)), points[:-1], points[1:], counts))
            if parts:
                owner, section, start, end, counts = map(np.concatenate, zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), *(pa.array(x.astype(np.int64)) for x in (section, start, end)), pa.array(counts)],
                    ["doc_id", "section", "start", "end", "n_tokens"],
                )

    return docs.mapInArrow(run, RESULT)
