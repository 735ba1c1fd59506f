"""Packing by a length histogram, shortest pack first.

Documents are tokenized once and cut into pieces of at most a sequence's length.
The histogram of piece lengths (at most as many entries as a sequence has
tokens, whatever the corpus) is packed on the driver: lengths are placed longest
first, each into the shortest pack that still has room, by counts and not one by
one. The patterns found that way go back to the pieces by their rank within
their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, n_parts, stored
from .token_pieces import encoder

SEQUENCE = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, and end_id, in pieces: all full sequences first, the rest as the last piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                doc, text = doc.as_py(), text.as_py()
                ids = np.append(np.frombuffer(enc.packed(text or ""), enc.dtype), end_id).astype("<u4")
                n = len(ids)
                for s in range(0, n, sequence):
                    part = ids[s : s + sequence]
                    out.append((doc, s, len(part), zlib.crc32(part), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        encoder(tokenizer_path).old = {}  # what an idle worker holds on to

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns as (how many sequences, lengths in it).

    Lengths go longest first; n pieces of a length go to the pattern with the most
    room if that has room for them, as many at a time as there are sequences of it,
    else each opens a sequence of its own. Each step makes or splits one pattern, so
    there are at most a few patterns for each distinct length.
    """
    room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(sequence + 1)]
    widest = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while widest and not room[widest]:
                widest -= 1
            if widest < length or not room[widest]:
                count, pattern, at = left, (), sequence
            else:
                count, pattern = room[widest].pop()
                at = widest
                if count > left:
                    room[at].append((count - left, pattern))
                    count = left
            room[at - length].append((count, (*pattern, length)))
            widest = max(widest, at - length)
            left -= count
    return [p for group in room for p in group]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks of its runs, ascending, and for each run the first sequence and the offset there."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    first = 0
    for count, pattern in patterns:
        at = 0
        for length in pattern:
            out.setdefault(length, []).append((filled.get(length, 0), first, at))
            filled[length] = filled.get(length, 0) + count
            at += length
        first += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A rank from 0 within each key, gapless, without one task per key.

    A key's rows are dealt over blocks by a hash; a row's rank is its place in
    its block plus what the key's earlier blocks hold.
    """
    blocks = 4 * n_parts(df.sparkSession)
    d = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    counts = counts.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order)) - 1
    d = d.withColumn("_in", inner)
    return d.join(counts, (d[key] == counts["_key"]) & (d["_block"] == counts["_b"])).withColumn("rank", F.col("_in") + F.col("_before")).drop("_block", "_b", "_key", "_in", "_before")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, pattern_length.

    Null and empty texts are one piece of end_id alone. Repeated rows are packed
    each for itself. A null id stays null. Longest texts are cut into full sequences and a rest. An
    empty table gives no rows. Columns but the two named are not read, so their names may clash with the result's.
    pattern_length is what the sequence holds before padding.
    """
    made = stored(pieces(docs, tokenizer_path, end_id, sequence, id_col, text_col), "pieces", SMALL_BATCHES)
    # at most `sequence` rows, one for each length
    histogram = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = shortest_pack_first(histogram, sequence)
    runs = made.sparkSession.sparkContext.broadcast((slots(patterns), np.cumsum([0] + [c for c, _ in patterns]), np.array([sum(p) for _, p in patterns] or [0], np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length, firsts, sums = runs.value
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (2, 5))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, sequence_id, offset = by_length[n]
                run = np.searchsorted(first, rank[at], "right") - 1
                seq[at] = sequence_id[run] + rank[at] - first[run]
                off[at] = offset[run]
            held = sums[np.searchsorted(firsts, seq, "right") - 1] if len(seq) else seq
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off), pa.array(held)], names=[*b.schema.names[:5], "sequence_id", "offset", "pattern_length"])

    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    with_rank = ranked(made, "length", order).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank"))
    return with_rank.mapInArrow(place, f"{PIECES}, sequence_id long, offset long, pattern_length long")
