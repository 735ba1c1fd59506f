"""Benchmark decontamination by an FM-index for each shard of training documents.

Words of the benchmark are the index's alphabet. A word that no benchmark item
has can be in no occurrence; it ends a run, and runs shorter than the shortest phrase hold none.
What is left of a shard, whole texts all, is indexed; all test phrases are searched
backwards in it, their occurrences located by sampled suffix positions, and merged to spans of words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex

#: Words of an item that make a phrase.
WINDOW = 10
#: A shard is closed at so many words, indexed or seen. It bounds memory alone.
SHARD_INDEXED, SHARD_WORDS = 1_000_000, 6_000_000
#: The benchmark is broadcast in parts of at most so many characters, a pass over the documents for each.
PART_CHARS = 32_000_000
# a byte is a word's if it is a digit, a letter (lower-cased) or not ASCII; all else separates
_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; maximal runs of digits, letters a-z and characters beyond ASCII."""
    return (text or "").encode().translate(_BYTES).split()


class Phrases:
    """Distinct windows of the items, by length, as rows of word numbers, and the items that have each."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1) if size else ():
                rows.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in sorted({len(r) for r in rows}):
            mine = sorted(r for r in rows if len(r) == size)
            self.by_length[size] = (np.array(mine, np.int64), [sorted(rows[r]) for r in mine])
        self.shortest = min(self.by_length, default=0)


def search_shard(phrases: Phrases, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """codes: word numbers of a shard's documents one after another (0: not in the benchmark); doc: document of each.

    Returns starts and ends (in codes) of the merged spans, and (document, item) for each occurrence's items.
    """
    n = len(codes)
    known = codes > 0
    border = np.r_[True, (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])] if n else np.zeros(0, bool)
    starts = np.flatnonzero(border)
    sizes = np.diff(np.r_[starts, n])
    keep = known[starts] & (sizes >= max(1, phrases.shortest))
    starts, sizes = starts[keep], sizes[keep]
    if not len(starts) or not phrases.by_length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    # runs one after another, a separator after each
    base = np.cumsum(np.r_[0, sizes + 1])
    source = np.repeat(starts - base[:-1], sizes + 1) + np.arange(base[-1])
    text = np.zeros(base[-1], np.int64)
    inside = np.ones(base[-1], bool)
    inside[base[1:] - 1] = False
    text[inside] = codes[source[inside]]
    index = FMIndex(text)
    from_, to, pairs = [], [], set()
    for size, (rows, items) in phrases.by_length.items():
        low, high = index.search(rows)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        if not len(found):
            continue
        before = np.cumsum(counts) - counts
        sa_rows = np.repeat(low[found] - before, counts) + np.arange(counts.sum())
        at = source[index.locate(sa_rows)]
        from_.append(at)
        to.append(at + size)
        which = np.repeat(found, counts)
        for d, p in np.unique(np.stack([doc[at], which]), axis=1).T:
            pairs.update((int(d), i) for i in items[p])
    if not from_:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    s, e = np.concatenate(from_), np.concatenate(to)
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by])
    # neighbours in different documents touch but never overlap; touching spans of one document are one
    new = np.r_[True, (s[1:] > e[:-1]) | (doc[s[1:]] != doc[s[:-1]])]
    return s[new], e[np.r_[new[1:], True]], sorted(pairs)


RESULT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def occurrences(docs: DataFrame, items: list[tuple[int, str]], window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: n_words, merged spans of hit words (end exclusive), items with an occurrence, and extra columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = held.value
        get = phrases.number.get
        parts: list[pa.RecordBatch] = []
        codes: list[np.ndarray] = []
        indexed = seen = 0

        def close() -> pa.RecordBatch:
            sizes = np.array([len(c) for c in codes], np.int64)
            flat, doc = np.concatenate(codes), np.repeat(np.arange(len(codes)), sizes)
            first = np.cumsum(sizes) - sizes
            starts, ends, pairs = search_shard(phrases, flat, doc)
            spans: list[list] = [[] for _ in codes]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                d = int(doc[s])
                spans[d].append({"start": s - int(first[d]), "end": e - int(first[d])})
            items_: list[list[int]] = [[] for _ in codes]
            for d, i in pairs:
                items_[d].append(i)
            rows = pa.concat_batches(parts)
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [rows.column(0), pa.array(sizes), pa.array(spans, kinds), pa.array(items_, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols + rows.columns[2:], names=["doc_id", "n_words", "spans", "items", *extra])

        for b in batches:
            done = 0
            for i, t in enumerate(b.column(1)):
                w = words(t.as_py())
                c = np.fromiter(map(get, w, repeat(0)), np.int32, len(w))
                codes.append(c)
                seen += len(c)
                indexed += int((c > 0).sum())
                if seen >= SHARD_WORDS or indexed >= SHARD_INDEXED:
                    parts.append(b.slice(done, i + 1 - done))
                    yield close()
                    parts, codes, indexed, seen, done = [], [], 0, 0, i + 1
            if done < b.num_rows:
                parts.append(b.slice(done))
        if codes:
            yield close()

    kinds = dict(docs.dtypes)
    schema = ", ".join([RESULT, *(f"`{c}` {kinds[c]}" for c in extra)])
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *extra).mapInArrow(work, schema)


def benchmark_parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in parts of bounded size, by hashes of ids; one part comes to the driver at a time.

    Null texts and ids are left out: they have no words or no name.
    """
    b = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = b.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    n = -(-chars // PART_CHARS) or 1
    for i in range(n):
        yield [(r.item_id, r.text) for r in (b if n == 1 else b.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)).orderBy("item_id", "text").collect()]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """occurrences() over all parts of the benchmark, united per row. Rows with the same id and text are alike in all parts: one is united, and given as often as it is there."""
    d = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    found = [occurrences(d, p, window, extra=("_key",)) for p in benchmark_parts(benchmark)]
    if len(found) == 1:
        return found[0].drop("_key")
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    united = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    all_ = all_.groupBy("doc_id", "_key", "n_words").agg(united("spans"), united("items"), (F.count("*") / len(found)).cast("int").alias("_times"))
    return all_.withColumn("_times", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("doc_id", "n_words", "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row for each input row.

    Null and empty texts have no words and no hits; an item without words is never found, one with fewer words than a window is one phrase.
    Items with the same text are all named, repeated rows of documents are each reported. An empty benchmark hits nothing, empty documents give no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit, n_items, sha = [], [], []
            for spans, items in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                end = hit = 0
                for s in sorted((x["start"], x["end"]) for x in spans):
                    hit += max(0, s[1] - max(s[0], end))
                    end = max(end, s[1])
                n_hit.append(hit)
                n_items.append(len(set(items)))
                sha.append(hashlib.sha256(",".join(sorted(map(str, set(items)))).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in n_hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return find(docs, benchmark, window).mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from a span's first to its last word."""
    at = [m.span() for m in _WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out, done = [], 0
    for s, e in sorted(spans):
        if at[s][0] > done:
            out.append(text[done : at[s][0]])
        done = max(done, at[e - 1][1])
    return "".join([*out, text[done:]])
