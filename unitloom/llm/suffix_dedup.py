"""Removal of byte strings that already start in an earlier document, by suffix sorting.

Every string of LENGTH bytes has an anchor: of its GRAM-byte strings the one with the
least hash. Equal strings have equal anchors at the same place, so each anchor's surroundings (all
strings of LENGTH bytes around it) meet all their equals in the anchor's bucket, and no suffix travels twice.

1. Anchors of all documents are dealt by hash; those in one document only are let go.
2. Documents send the surroundings of the anchors left. Equal surroundings become one, of the smallest document; the others are covered whole.
3. In each bucket a suffix array over the surroundings is built by two-stage sorting. Neighbours
   with LENGTH bytes in common form a group, and all but the smallest document's members are covered.
4. Covered spans are merged per document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_parts
from .packed import binary, ends_of, pack, starts_of, unpack
from .packed import rows as batch
from .two_stage_sort import joined, neighbours_prefix, suffix_array

LENGTH, GRAM = 50, 24
LEFT = LENGTH - GRAM  # bytes before an anchor that a string around it can have
WIDE = LEFT + LENGTH  # bytes of an anchor's surroundings
ROW = 80  # surroundings, both clips, filled up to whole words
#: Bytes worked on at once: bounds memory alone. A suffix array spans at most so many surroundings, but never splits an anchor's.
CHUNK, SORTED = 2_000_000, 16_384
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_TABLE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    with np.errstate(over="ignore"):
        h, size, power = _TABLE[data], 1, _MIX
        powers = {1: h}
        while size * 2 <= GRAM:  # strings twice as long from two halves
            h = h[: max(0, len(h) - size)] * power + h[size:]
            size, power = size * 2, power * power
            powers[size] = h
        out, at = None, 0
        for s in sorted(powers, reverse=True):
            if at + s <= GRAM:
                part = powers[s]
                n = max(0, len(data) - GRAM + 1)
                out = part[:n] if out is None else out * _MIX2 + part[at : at + n]
                at += s
        out = (out ^ (out >> np.uint64(31))) * _MIX2
        return out ^ (out >> np.uint64(29))


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = pick(a[:-size], a[size:])
        size *= 2
    return pick(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, position, hash) of all anchors of the texts' LENGTH-byte strings."""
    whos, ats, hashes = [], [], []

    def work(group: list[tuple[int, int, bytes]]) -> None:
        if not group:
            return
        who, base = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        size = np.array([len(g[2]) for g in group])
        data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        end = np.repeat(np.cumsum(size), size)
        h = gram_hashes(data)
        width = LEFT + 1
        least = _sliding(h, width, np.minimum)
        inside = np.arange(len(least)) + LENGTH <= end[: len(least)]  # strings within one text
        # a position is an anchor if a string that holds it has it as its least: least values never exceed it, so the largest decides
        least = np.where(inside, least, np.uint64(0))
        most = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
        at = np.flatnonzero((most[: len(h)] == h) & (h > 0))
        part = np.searchsorted(np.cumsum(size), at, "right")
        whos.append(who[part])
        ats.append(at - (np.cumsum(size) - size)[part] + base[part])
        hashes.append(h[at])

    group, held = [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - LENGTH + 1), CHUNK):  # long texts in parts that overlap
            part = t[s : s + CHUNK + LENGTH - 1]
            if len(part) >= LENGTH:
                group.append((i, s, part))
                held += len(part)
        if held >= CHUNK:
            work(group)
            group, held = [], 0
    work(group)
    if not whos:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    who, at, h = np.concatenate(whos), np.concatenate(ats), np.concatenate(hashes)
    if any(len(t) > CHUNK for t in texts):  # parts that overlap may find an anchor twice
        keep = np.r_[True, (who[1:] != who[:-1]) | (at[1:] != at[:-1])]
        o = np.lexsort((at, who))
        who, at, h = who[o], at[o], h[o]
        keep = np.r_[True, (who[1:] != who[:-1]) | (at[1:] != at[:-1])]
        who, at, h = who[keep], at[keep], h[keep]
    return who, at, h


def shared_anchors(base: DataFrame, n: int) -> DataFrame:
    """(row, hashes): for each row the anchors (the upper halves of their hashes) that more than one document has.

    An anchor that several documents of one batch have is known at once, and goes to its bucket once for the batch.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, docs = b.column(0).to_numpy(), b.column(1).fill_null(-(1 << 63)).to_numpy()
            who, _, h = anchors([t.as_py().encode() for t in b.column(2)])
            o = np.lexsort((docs[who], h))
            who, h = who[o], h[o]
            doc = docs[who]
            first = starts_of(h)
            size = np.diff(np.r_[first, len(h)])
            common = np.repeat(doc[first] != doc[first + size - 1], size) if len(h) else np.zeros(0, bool)
            bucket = (h % np.uint64(n)).astype(np.int64)
            top = (h >> np.uint64(32)).astype(np.uint32)
            # found here: straight to the row
            c = np.flatnonzero(common)
            yield from _to_rows(rows[who[c]], top[c], n)
            # to the buckets: common ones once, with no row; single ones with theirs
            for kind, pick in ((2, first[common[first]] if len(h) else first), (0, np.flatnonzero(~common))):
                pick = pick[np.argsort(bucket[pick], kind="stable")]
                s = starts_of(bucket[pick])
                ends = ends_of(s, len(pick))
                data = []
                for a, e in zip(s, ends, strict=True):
                    p = pick[a:e]
                    if kind == 0:  # by row: runs of one row, then its anchors
                        p = p[np.argsort(who[p], kind="stable")]
                        run = starts_of(who[p])
                        data.append(len(run).to_bytes(4, "little") + rows[who[p][run]].tobytes() + np.diff(np.r_[run, len(p)]).astype(np.uint32).tobytes() + top[p].tobytes())
                    else:
                        data.append(top[p].tobytes())
                if len(s):
                    yield batch(_DEALT, _DEALT_KINDS, np.full(len(s), kind, np.int32), bucket[pick][s].astype(np.int32), (ends - s).astype(np.int32), data)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tops, marks = [], [], []
        for b in batches:
            mine = b.column(0).to_numpy()
            yield b.filter(pa.array(mine == 1))
            for kind, size, t in zip(mine.tolist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if kind == 2:
                    marks.append(np.frombuffer(t, np.uint32))
                elif kind == 0:
                    runs = int.from_bytes(t[:4], "little")
                    keys.append(np.repeat(np.frombuffer(t, np.int64, runs, 4), np.frombuffer(t, np.uint32, runs, 4 + 8 * runs)))
                    tops.append(np.frombuffer(t, np.uint32, size, 4 + 12 * runs))
        if not keys:
            return
        key, top = np.concatenate(keys), np.concatenate(tops)
        del keys, tops
        o = np.argsort(top, kind="stable")
        key, top = key[o], top[o]
        first = starts_of(top)
        size = np.diff(np.r_[first, len(top)])
        shared = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)  # of more than one row
        if marks:
            shared |= np.isin(top[first], np.unique(np.concatenate(marks)))
        keep = np.repeat(shared, size)
        yield from _to_rows(key[keep], top[keep], n)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(data, size, "i8", "u4") for b in batches for size, data in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        if not parts:
            return
        key, top = (np.concatenate(c) for c in zip(*parts, strict=True))
        o = np.argsort(key, kind="stable")
        key, top = key[o], top[o]
        s = starts_of(key)
        for i in range(0, len(s), 20_000):
            part = s[i : i + 20_000]
            upto = s[i + 20_000] if i + 20_000 < len(s) else len(key)
            yield batch(["row", "hashes"], [pa.int64(), pa.binary()], key[part], binary(top[part[0] : upto], part - part[0]))

    schema = "kind int, bucket int, size int, data binary"
    to = F.pmod("bucket", F.lit(n)).cast("int")
    dealt = base.select("row", "doc", "text").mapInArrow(deal, schema).repartitionById(n, to).mapInArrow(judge, schema)
    return dealt.repartitionById(n, to).mapInArrow(gather, "row long, hashes binary")


_DEALT = ["kind", "bucket", "size", "data"]
_DEALT_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _to_rows(key: np.ndarray, top: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """(row, anchor) pairs packed by the partition that gathers the row."""
    if not len(key):
        return
    target = key % n
    o = np.lexsort((top, key, target))
    key, top, target = key[o], top[o], target[o]
    s = starts_of(target)
    ends = ends_of(s, len(key))
    yield batch(_DEALT, _DEALT_KINDS, np.ones(len(s), np.int32), target[s].astype(np.int32), (ends - s).astype(np.int32), [pack(key[a:e], top[a:e]) for a, e in zip(s, ends, strict=True)])


def _surroundings(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A line of ROW bytes for each anchor: WIDE bytes around it, zeros beyond the text's ends, and how many bytes are real before and after."""
    col = at[:, None] - LEFT + np.arange(WIDE)
    real = (col >= start[:, None]) & (col < end[:, None])
    out = np.zeros((len(at), ROW), np.uint8)
    out[:, :WIDE] = np.where(real, data[np.clip(col, 0, len(data) - 1)], 0)
    out[:, WIDE] = np.minimum(LEFT, at - start)
    out[:, WIDE + 1] = np.minimum(LENGTH, end - at)
    return out


def _packed_lines(doc: np.ndarray, row: np.ndarray, at: np.ndarray, lines: np.ndarray) -> bytes:
    run = starts_of(row)
    size = np.diff(np.r_[run, len(row)])
    step = np.diff(at, prepend=0).astype(np.int32)
    return len(run).to_bytes(4, "little") + pack(row[run], doc[run], size.astype(np.uint32), step, lines[:, : WIDE + 2])


def _unpacked_lines(data: bytes, n: int) -> tuple[np.ndarray, ...]:
    runs = int.from_bytes(data[:4], "little")
    raw = unpack(data[4:], 1, f"({runs},)i8", f"({runs},)i8", f"({runs},)u4", f"({n},)i4", f"({n},{WIDE + 2})u1")
    row, doc, size, step, part = (x[0] for x in raw)
    lines = np.zeros((n, ROW), np.uint8)
    lines[:, : WIDE + 2] = part
    return np.repeat(doc, size), np.repeat(row, size), np.cumsum(step.astype(np.int64)), lines


def _line_hash(lines: np.ndarray) -> np.ndarray:
    words = lines.view(np.uint64)
    h = np.zeros(len(lines), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words.shape[1]):
            h = (h ^ words[:, i]) * _MIX2
            h ^= h >> np.uint64(31)
    return h


def _same_lines(h: np.ndarray, lines: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by line and then document, and the first of each group of equal lines in it."""
    o = np.lexsort((doc, _line_hash(lines), h))
    a = lines[o]
    return o, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]).any(1) | (h[o][1:] != h[o][:-1])]) if len(o) else np.zeros(0, np.int64)


def _spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch | None:
    """Merged spans as (row, pairs of start and end)."""
    if not len(row):
        return None
    o = np.lexsort((start, row))
    row, start, end = row[o], start[o], end[o]
    first = starts_of(row)
    number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(row)])).astype(np.int64)
    reach = np.maximum.accumulate(end + (number << 40)) - (number << 40)  # never carried over from the row before
    new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1])]
    pairs = np.stack([start[new], reach[np.r_[new[1:], True]]], 1).astype(np.uint32)
    row = row[new]
    s = starts_of(row)
    return pa.RecordBatch.from_arrays([pa.array(row[s]), binary(pairs.view(np.uint64).ravel(), s)], names=["row", "spans"])


def covered_strings(lines: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, start, end) of runs of LENGTH-byte strings in each line that a line of a smaller document has too, by suffix sorting."""
    left, length = lines[:, WIDE].astype(np.int64), lines[:, WIDE].astype(np.int64) + lines[:, WIDE + 1]
    col = np.minimum(LEFT - left[:, None] + np.arange(WIDE), WIDE - 1)
    t, start = joined(np.take_along_axis(lines, col, 1), length)
    order = suffix_array(t)
    line = np.searchsorted(start, order, "right") - 1
    offset = order - start[line]
    whole = offset + LENGTH <= length[line]  # suffixes that begin such a string
    order, line, offset = order[whole], line[whole], offset[whole]
    if not len(order):
        return line, offset, offset
    group = np.flatnonzero(neighbours_prefix(t, order, LENGTH) < LENGTH)
    least = np.repeat(np.minimum.reduceat(doc[line], group), np.diff(np.r_[group, len(order)]))
    hit = doc[line] > least
    line, offset = line[hit], offset[hit]
    o = np.lexsort((offset, line))
    line, offset = line[o], offset[o]
    new = np.r_[True, (line[1:] != line[:-1]) | (offset[1:] > offset[:-1] + LENGTH)] if len(o) else np.zeros(0, bool)
    last = np.r_[new[1:], True] if len(o) else new
    return line[new], offset[new], offset[last] + LENGTH


def covered(base: DataFrame, side: DataFrame, n: int) -> DataFrame:
    """(row, spans) of covered bytes; rows may come up several times."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(bucket: list, size: list, data: list, spans: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if bucket:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "size": pa.array(size, pa.int32()), "data": pa.array(data, pa.binary())})
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array((spans.column(0).to_numpy() % n).astype(np.int32)), pa.array(np.zeros(spans.num_rows, np.int32)), pa.array([r.to_bytes(8, "little", signed=True) + d for r, d in zip(spans.column(0).to_pylist(), spans.column(1).to_pylist(), strict=True)], pa.binary())], names=["bucket", "size", "data"])

        def work(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            texts = [g[2] for g in group]
            rows, docs = np.array([g[0] for g in group], np.int64), np.array([g[1] for g in group], np.int64)
            who, at, h = anchors(texts)
            size = np.array([len(t) for t in texts])
            top = (h >> np.uint64(32)).astype(np.uint32)
            # an anchor of a text is wanted if the text's own list has it
            lists = [np.frombuffer(g[3], np.uint32) for g in group]
            want = np.unique((np.repeat(np.arange(len(group), dtype=np.uint64), [len(x) for x in lists]) << np.uint64(32)) | np.concatenate(lists).astype(np.uint64))
            keep = np.isin((who.astype(np.uint64) << np.uint64(32)) | top, want)
            who, at, h = who[keep], at[keep], h[keep]
            if not len(who):
                return
            data = np.frombuffer(b"".join(texts), np.uint8)
            base_ = np.cumsum(size) - size
            lines = _surroundings(data, base_[who], (base_ + size)[who], base_[who] + at)
            doc, row = docs[who], rows[who]
            o, first = _same_lines(h, lines, doc)
            count = np.diff(np.r_[first, len(o)])
            least = np.repeat(doc[o[first]], count)
            later = doc[o] > least
            c = o[later]  # covered here already
            spans = _spans(row[c], at[c] - lines[c, WIDE].astype(np.int64), at[c] + lines[c, WIDE + 1].astype(np.int64)) if len(c) else None
            m = o[~later]
            bucket = (h[m] % np.uint64(n)).astype(np.int64)
            by = np.lexsort((at[m], who[m], bucket))  # by text within a bucket: what is alike lies together and packs well
            m, bucket = m[by], bucket[by]
            s = starts_of(bucket)
            ends = ends_of(s, len(m))
            parts = [m[a:b] for a, b in zip(s, ends, strict=True)]
            yield from pack(bucket[s].tolist(), [len(p) for p in parts], [_packed_lines(doc[p], row[p], at[p], lines[p]) for p in parts], spans)

        for b in batches:
            group, held = [], 0
            whole: list[tuple] = []
            for row, doc, text, lists, copy in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode()
                if len(data) < LENGTH:
                    continue
                if copy:
                    whole.append((row, len(data)))
                elif lists:
                    group.append((row, -(1 << 63) if doc is None else doc, data, b"".join(lists)))
                    held += len(data)
                    if held >= 4 * CHUNK:
                        yield from work(group)
                        group, held = [], 0
            if group:
                yield from work(group)
            if whole:
                r, e = np.array([w[0] for w in whole], np.int64), np.array([w[1] for w in whole], np.int64)
                yield from pack([], [], [], _spans(r, np.zeros(len(r), np.int64), e))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for b in batches:
            rows, spans = [], []
            for size, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if size:
                    parts.append(_unpacked_lines(data, size))
                else:
                    rows.append(int.from_bytes(data[:8], "little", signed=True))
                    spans.append(data[8:])
            if rows:
                yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "spans": pa.array(spans, pa.binary())})
        if not parts:
            return
        doc, row, at, lines = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        h = np.concatenate([gram_hashes(np.ascontiguousarray(lines[i : i + 50_000, LEFT:LENGTH]).reshape(-1))[::GRAM] for i in range(0, len(lines), 50_000)])
        o, first = _same_lines(h, lines, doc)
        count = np.diff(np.r_[first, len(o)])
        later = doc[o] > np.repeat(doc[o[first]], count)
        c = o[later]
        if out := _spans(row[c], at[c] - lines[c, WIDE].astype(np.int64), at[c] + lines[c, WIDE + 1].astype(np.int64)):
            yield out
        # one line for each group; an anchor with one line alone has nothing to be compared with
        head = o[first]
        starts = starts_of(h[head])
        size = np.diff(np.r_[starts, len(head)])
        several = np.flatnonzero(np.repeat(size > 1, size))
        anchor = np.repeat(np.cumsum(size > 1), size)[several]
        number = np.repeat(np.arange(len(first)), count)
        members, where = o[~later], number[~later]  # those of a line's least document, by line
        lo = 0
        while lo < len(several):
            hi = min(lo + SORTED, len(several))
            hi = int(np.searchsorted(anchor, anchor[hi - 1], "right"))  # up to an anchor's end
            mine = several[lo:hi]
            lo = hi
            line, begin, end = covered_strings(lines[head[mine]], doc[head[mine]])
            line = mine[line]
            low, high = np.searchsorted(where, line, "left"), np.searchsorted(where, line, "right")
            k = high - low
            m = members[np.repeat(low - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            zero = at[m] - lines[m, WIDE].astype(np.int64)
            if out := _spans(row[m], zero + np.repeat(begin, k), zero + np.repeat(end, k)):
                yield out

    sent = base.join(side.hint("shuffle_hash"), base["row"] == side["srow"]).select(base["row"], "doc", "text", "lists", "copy").mapInArrow(send, "bucket int, size int, data binary")
    return sent.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).mapInArrow(sort, "row long, spans binary")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text, spans): each input row with the spans of bytes to be removed, as packed pairs of 32-bit numbers, not yet merged.

    Null texts count as empty. Rows with the same id are the same document: none covers another.
    """
    n = n_parts(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.select(F.xxhash64("doc", "text").alias("row"), "doc", "text")
    base = d.repartition(n, "row")  # dealt once, read again for the last step
    # copies of a whole text: all but the smallest document's are covered from end to end
    prints = d.where(F.octet_length("text") >= LENGTH).select("row", "doc", F.sha2("text", 256).alias("sha"))
    least = prints.groupBy("sha").agg(F.min(F.coalesce("doc", F.lit(-(1 << 63)))).alias("least"))
    copies = prints.join(least, "sha").where(F.col("doc") > F.col("least")).select("row", F.lit(None).cast("binary").alias("hashes"), F.lit(1).alias("copy"))
    shared = shared_anchors(d, n).select("row", "hashes", F.lit(0).alias("copy"))
    side = shared.unionByName(copies).groupBy(F.col("row").alias("srow")).agg(F.collect_list("hashes").alias("lists"), F.max("copy").alias("copy"))
    spans = covered(base, side, n).groupBy(F.col("row").alias("srow")).agg(F.collect_list("spans").alias("spans"))
    return base.join(spans.hint("shuffle_hash"), base["row"] == spans["srow"], "left").select("doc", "text", "spans")


def merged(spans: list[bytes] | None) -> np.ndarray:
    """Disjoint spans (start, end), ascending; spans that touch are one."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    p = np.frombuffer(b"".join(spans), np.uint32).reshape(-1, 2).astype(np.int64)
    p = p[np.argsort(p[:, 0], kind="stable")]
    reach = np.maximum.accumulate(p[:, 1])
    new = np.r_[True, p[1:, 0] > reach[:-1]]
    return np.stack([p[new, 0], reach[np.r_[new[1:], True]]], 1)


def report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte that lies in a string of LENGTH bytes which also starts in a document with a smaller id; strings are judged on
    the input, and never cross documents. Texts that are null or shorter keep all. Null ids count as the smallest.
    Repeated rows (same id) never cover each other. An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, gone = text.encode(), merged(spans)
                at, kept = 0, []
                for s, e in gone.tolist():
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                out.append((doc, len(data), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(b"".join(kept)).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return repeated_spans(docs).mapInArrow(cut, RESULT)
