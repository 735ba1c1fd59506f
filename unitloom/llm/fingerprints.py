"""Lempel-Ziv phrase fingerprints.

A document's UTF-8 bytes are parsed into dictionary phrases: each phrase is the
shortest string not in the dictionary yet, which it then joins. The set of phrases,
held by their hashes, stands for the document the way a compressor's dictionary
does, and the share of equal entries in two minimum-hash signatures estimates how
much of two dictionaries is shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts, range_block, range_bounds

#: Entries of a signature, and their bits (as hex digits of the fingerprint).
ENTRIES, DIGITS = 64, 4
_STEP, _LOW = 1_000_003, (1 << 58) - 1  # phrase hash: polynomial over the bytes, 58 bits
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, ENTRIES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, ENTRIES, dtype=np.uint64)


def parse(data: bytes, seen: set[int], state: int = 0) -> int:
    """Adds the phrases of data to seen; state is the hash of the phrase begun so far, and the new one is returned."""
    add, h, step, low = seen.add, state, _STEP, _LOW
    for b in data:
        h = (h * step + b + 1) & low
        if h not in seen:
            add(h)
            h = 0
    return h


def signature(seen: set[int]) -> np.ndarray:
    """Least value of each hash function over the phrases; all ones for no phrases."""
    if not seen:
        return np.full(ENTRIES, (1 << 4 * DIGITS) - 1, np.uint16)
    h = np.fromiter(seen, np.uint64, len(seen))
    h ^= h >> np.uint64(29)
    least = np.full(ENTRIES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 4096):  # bounds the table of phrases by functions
        least = np.minimum(least, (h[i : i + 4096, None] * _A + _B).min(0))
    return (least >> np.uint64(16)).astype(np.uint16)  # the least values are small: their high bits alone would all be alike


def fingerprint(text: str) -> str:
    seen: set[int] = set()
    parse(text.encode(), seen)
    return signature(seen).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal entries of two fingerprints."""
    return sum(a[i : i + DIGITS] == b[i : i + DIGITS] for i in range(0, len(a), DIGITS)) / ENTRIES


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, last, id, text): rows dealt into ranges of ids, each in one task and sorted, and ended by a row with
    last = 1 that repeats the next range's first row (after the final range: the very first row)."""
    n = n_parts(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("block", range_block("id", range_bounds(d, "id", n)))
    firsts = d.groupBy("block").agg(F.min(F.struct("id", "text")).alias("first"))  # a row for each range
    w = Window.orderBy("block")
    after = F.coalesce(F.lead("first").over(w), F.first("first").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = firsts.select("block", F.lit(1).alias("last"), after.alias("a")).select("block", "last", "a.id", "a.text")
    d = d.select("block", F.lit(0).alias("last"), "id", "text").unionByName(ends)
    return d.repartitionById(n, F.col("block")).sortWithinPartitions("block", "last", F.col("id").asc_nulls_first(), "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how near they and the next document's are.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next
    document (by ascending id; rows with the same id go by text, null ids come first; after the last document comes the first).
    Null and empty texts have no phrases: their fingerprint is all ones, near another such 1 and near anything else 0.
    Texts are parsed whole. An empty table gives no rows. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before: id, text, its signature
        block = None

        def row(doc, text: str, sig: np.ndarray, half: tuple, nxt: str, nxt_sig: np.ndarray) -> tuple:
            n = len(text)
            edited = text[: n - n // 2] + nxt[: n // 2]
            seen, state = half
            parse(nxt[: n // 2].encode(), seen, state)
            e = signature(seen)
            return (doc, n, hashlib.sha256(edited.encode()).hexdigest(), sig.tobytes().hex(), e.tobytes().hex(), float((sig == e).mean()), float((sig == nxt_sig).mean()))

        for b in batches:
            out = []
            for k, last, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != block:
                    held, block = None, k
                seen: set[int] = set()
                keep = len(text) - len(text) // 2
                state = parse(text[:keep].encode(), seen)
                half = (set(seen), state)  # where the edited text goes on
                parse(text[keep:].encode(), seen, state)
                sig = signature(seen)
                if held:
                    out.append(row(*held, text, sig))
                held = None if last else (doc, text, sig, half)
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return in_order(docs, id_col, text_col).mapInArrow(work, RESULT)
