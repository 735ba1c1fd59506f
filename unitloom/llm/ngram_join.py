"""Jaccard join on word n-grams with adaptive multi-match prefixes.

1. Every document becomes the set of its shingles' hashes; documents with equal sets are one class.
2. Shingles are dealt by hash and counted over all classes. A shingle of one class alone can be
   shared with nobody, so from here on a class is its size and its shared shingles.
3. Shingles are ordered by rarity. Two sets of Jaccard >= t whose prefixes are |x| - ceil(t |x|) + l long
   share at least l shingles of their prefixes. Each class picks its own l by estimated cost: a longer prefix
   meets more postings, but must match more often before a pair is verified. A pair needs the smaller of its two l.
4. Pairs that match often enough are verified on all their shared shingles.
5. Links give components. Posting lists beyond LIST members first link neighbours and a few leaders. Lists with the same
   first leader then form a cluster; what lies across components in it is compared block by block, so
   that a large group of near copies is never spread into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_parts, stored
from .components import components
from .packed import binary, ends_of, pack, rows, starts_of, unpack

N, PERCENT = 5, 80  # words of a shingle; similarity
#: Longest extension of a prefix; a verified shingle costs so much of a posting met.
MOST_MATCHES, VERIFY = 6, 0.25
#: A posting list up to so long gives all its pairs at once; a longer one first NEAR neighbours and LEADERS, then what components leave.
LIST, NEAR, LEADERS = 8, 1, 2
#: Members of a block, about; columns of shingles compared at once.
BLOCK, COLUMNS = 512, 8192
#: Bytes of text worked on at once: bounds memory alone.
CHUNK = 1_500_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, N + 1, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word: differences of a running sum of bytes times powers, brought back to power 0."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power = np.full(len(data) + 1, _P, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.uint64(pow(_P, -1, 1 << 64))
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * power[:-1])]
    # the inverse's powers at word starts, by gaps between them, would be a product as well
    back = np.full(len(data) + 1, inverse, np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    return start, _mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, shingle hash), distinct, sorted: all words runs of N, a shorter text's whole sequence as one."""
    size = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    start, h = word_hashes(data)
    who = np.searchsorted(np.cumsum(size), start, "right")
    n = len(h)
    full = max(0, n - N + 1)
    s = np.zeros(full, np.uint64)
    for i in range(N):
        s += h[i : i + full] * _PLACE[i]
    within = who[:full] == who[N - 1 :] if full else np.zeros(0, bool)
    ids, hashes = [who[:full][within]], [_mixed(s[within])]
    words = np.bincount(who, minlength=len(texts))
    first = np.cumsum(words) - words
    for d in np.flatnonzero((words > 0) & (words < N)):
        part = h[first[d] : first[d] + words[d]]
        ids.append(np.array([d]))
        hashes.append(_mixed((part * _PLACE[: len(part)]).sum(keepdims=True) + _PLACE[N] * np.uint64(len(part))))
    who, h = np.concatenate(ids), np.concatenate(hashes)
    o = np.lexsort((h, who))
    who, h = who[o], h[o]
    new = np.r_[True, (who[1:] != who[:-1]) | (h[1:] != h[:-1])] if len(o) else np.zeros(0, bool)
    return who[new], h[new]


def set_keys(who: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, key) of each text's set; equal sets have equal keys. Empty sets have key 0 and size 0."""
    sizes = np.bincount(who, minlength=n).astype(np.int64)
    key = np.zeros(n, np.uint64)
    first = starts_of(who)
    if len(first):
        key[who[first]] = _mixed(np.add.reduceat(_mixed(h + _PLACE[0]), first) + sizes[who[first]].astype(np.uint64) * _PLACE[1])
    return sizes, key.view(np.int64)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= CHUNK:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_DEALT = ["kind", "bucket", "size", "data"]
_DEALT_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def counted(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Steps 1 and 2: kind 1 packs (key, doc_id, set size) of documents, kind 0 (key, shingle, bucket, count) of shared shingles, by the class's partition."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # of equal sets in a task one is sent
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            ids = b.column(0)
            texts = [(t or "").encode().translate(_LOWER) for t in b.column(1).to_pylist()]
            if len(sent) > 1_000_000:  # bounds memory alone
                sent.clear()
            with np.errstate(over="ignore"):
                for lo, hi in _groups(texts):
                    who, h = shingle_sets(texts[lo:hi])
                    size, key = set_keys(who, h, hi - lo)
                    part = np.array([x if x is not None else -(1 << 63) for x in ids.slice(lo, hi - lo).to_pylist()], np.int64)
                    yield rows(_DEALT, _DEALT_KINDS, [1], [int(key[0] % n)], [hi - lo], [pack(key, part, size)])
                    fresh = np.zeros(hi - lo, bool)
                    for i, k in enumerate(key.tolist()):
                        if size[i] and k not in sent:
                            sent.add(k)
                            fresh[i] = True
                    keep = fresh[who]
                    w, x = who[keep], h[keep]
                    bucket = (x % np.uint64(n)).astype(np.int64)
                    o = np.argsort(bucket, kind="stable")
                    w, x, bucket = w[o], x[o], bucket[o]
                    s = starts_of(bucket)
                    ends = ends_of(s, len(x))
                    blobs = []
                    for a, e in zip(s, ends, strict=True):
                        run = starts_of(w[a:e])
                        top = (x[a:e] >> np.uint64(32)).astype(np.uint32)
                        count = np.diff(np.r_[run, e - a])
                        blobs.append(len(run).to_bytes(4, "little") + key[w[a:e][run]].tobytes() + count.astype(np.uint32).tobytes() + top.tobytes())
                    if len(s):
                        yield rows(_DEALT, _DEALT_KINDS, np.zeros(len(s), np.int32), bucket[s].astype(np.int32), (ends - s).astype(np.int32), blobs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for kind, bucket, size, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 1:
                    yield rows(_DEALT, _DEALT_KINDS, [1], [bucket], [size], [data])
                    continue
                runs = int.from_bytes(data[:4], "little")
                k = np.frombuffer(data, np.int64, runs, 4)
                c = np.frombuffer(data, np.uint32, runs, 4 + 8 * runs)
                held.setdefault(bucket, []).append((np.repeat(k, c), np.frombuffer(data, np.uint32, size, 4 + 12 * runs)))
        for bucket, parts in held.items():
            key, top = (np.concatenate(c) for c in zip(*parts, strict=True))
            parts.clear()
            o = np.lexsort((key, top))
            key, top = key[o], top[o]
            new = np.r_[True, (top[1:] != top[:-1]) | (key[1:] != key[:-1])]  # a class that several batches have counts once
            key, top = key[new], top[new]
            first = starts_of(top)
            many = np.diff(np.r_[first, len(top)])
            c = np.repeat(many, many)
            keep = c > 1
            key, top, c = key[keep], top[keep], c[keep].astype(np.uint32)
            target = key % n
            o = np.lexsort((top, key, target))
            key, top, c, target = key[o], top[o], c[o], target[o]
            s = starts_of(target)
            if len(s):  # packed by the partition that gathers the class
                ends = ends_of(s, len(key))
                data = [pack(key[a:e], top[a:e], np.full(e - a, bucket, np.uint32), c[a:e]) for a, e in zip(s, ends, strict=True)]
                yield rows(_DEALT, _DEALT_KINDS, np.zeros(len(s), np.int32), target[s].astype(np.int32), (ends - s).astype(np.int32), data)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = d.mapInArrow(deal, "kind int, bucket int, size int, data binary")
    return dealt.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).mapInArrow(count, "kind int, bucket int, size int, data binary")


def _members(made: DataFrame) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key, doc, many = unpack(data, size, "i8", "i8", "i8")
                yield rows(["doc_id", "set_size", "key"], [pa.int64()] * 3, doc, many, key)

    return made.where("kind = 1").select("size", "data").mapInArrow(spread, "doc_id long, set_size long, key long")


def choose(size: int, counts: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """(l, shared shingles in the prefix) of least estimated cost, for a set of `size` with these counts of shared shingles, ascending.

    Shingles of this class alone come first in rarity and match nobody. A prefix meets sum(count - 1) postings; at most
    that / l classes can match l times, each verified over the whole set.
    """
    alone = size - len(counts)
    base = size - -(-percent * size // 100)
    met = np.r_[0, np.cumsum(counts.astype(np.int64) - 1)]
    best = None
    for l in range(1, MOST_MATCHES + 1):
        if base + l > size:
            break
        k = max(0, base + l - alone)
        cost = met[k] + VERIFY * size * met[k] / l
        if best is None or cost < best[0]:
            best = (cost, l, k)
    return best[1:]


def postings(sets: DataFrame, n: int, percent: int = PERCENT) -> DataFrame:
    """Step 3: (bucket, size, data): packed (shingle, key, set size, l) of all prefixes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, size, many, codes, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                code, counts = unpack(codes, many, "u8")[0], unpack(data, many, "u4")[0]
                o = np.lexsort((code, counts))  # by rarity, ties by the shingle: one order for all
                l, k = choose(size, counts[o], percent)
                if k:
                    out.append((code[o[:k]], key, size, l))
            if not out:
                continue
            code = np.concatenate([x[0] for x in out])
            times = [len(x[0]) for x in out]
            key, size, l = (np.repeat(np.array([x[i] for x in out], np.int64), times) for i in (1, 2, 3))
            bucket = (_mixed(code) % np.uint64(n)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            s = starts_of(bucket[o])
            ends = ends_of(s, len(o))
            data = [pack(code[o[a:e]], key[o[a:e]], size[o[a:e]].astype(np.uint32), l[o[a:e]].astype(np.uint8)) for a, e in zip(s, ends, strict=True)]
            yield rows(["bucket", "size", "data"], [pa.int32(), pa.int32(), pa.binary()], bucket[o][s].astype(np.int32), (ends - s).astype(np.int32), data)

    with np.errstate(over="ignore"):
        return sets.select("key", "size", "many", "codes", "data").mapInArrow(work, "bucket int, size int, data binary")


def _pairs_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For groups of such sizes one after another: (first, second, group) of all pairs within each."""
    n = int(sizes.sum())
    group = np.repeat(np.arange(len(sizes)), sizes)
    end = np.cumsum(sizes)[group]
    left = end - np.arange(n) - 1
    a = np.repeat(np.arange(n), left)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
    return a, b, group[a]


def _read_postings(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """(shingle, key, set size, l) of a bucket, lists one after another, members by set size, and each list's first and length."""
    parts = [unpack(data, size, "u8", "i8", "u4", "u1") for b in batches for size, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    if not parts:
        return None
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    o = np.lexsort((cols[1], cols[2], cols[0]))
    code, key, size, l = (c[o] for c in cols)
    first = starts_of(code)
    return key, size.astype(np.int64), l, first, np.diff(np.r_[first, len(code)])


def _leaders(key: np.ndarray, many: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.argsort(_mixed(key.view(np.uint64)))[:many]


def matches(dealt: DataFrame, n: int, percent: int = PERCENT) -> DataFrame:
    """Step 4's candidates (a, b), a < b, within the sizes that can be similar: of short lists all pairs, of long ones neighbours and leaders."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _read_postings(batches)
        if got is None:
            return
        key, size, l, first, many = got
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def take(a: np.ndarray, b: np.ndarray) -> None:
            ok = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
            held.append((a[ok], b[ok]))

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            x, y, need = np.minimum(key[a], key[b]), np.maximum(key[a], key[b]), np.minimum(l[a], l[b])
            o = np.lexsort((y, x))
            x, y, need = x[o], y[o], need[o]
            s = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
            yield rows(["a", "b", "met", "need"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()], x[s], y[s], np.diff(np.r_[s, len(x)]).astype(np.int32), need[s].astype(np.int32))

        short = (many > 1) & (many <= LIST)
        g, m = first[short], many[short]
        for i in range(0, len(g), 100_000):
            a, b, which = _pairs_of(m[i : i + 100_000])
            shift = g[i : i + 100_000] - (np.cumsum(m[i : i + 100_000]) - m[i : i + 100_000])
            take(a + shift[which], b + shift[which])
        for f, m in zip(first[many > LIST], many[many > LIST], strict=True):
            at = np.arange(f, f + m)
            for d in range(1, NEAR + 1):
                take(at[:-d], at[d:])
            for x in at[_leaders(key[at], LEADERS)]:
                others = at[at != x]
                take(np.full(len(others), x), others)
        yield from flush()

    met = dealt.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).mapInArrow(work, "a long, b long, met int, need int")
    # a pair of a long list may have met more often than was counted here: clusters compare all of those
    return met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("need").alias("need")).where("met >= need").select("a", "b")


def clusters(dealt: DataFrame, n: int) -> DataFrame:
    """(leader, key): members of long lists under the first leader of each list."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _read_postings(batches)
        if got is None:
            return
        key, _, _, first, many = got
        leader, member = [], []
        for f, m in zip(first[many > LIST], many[many > LIST], strict=True):
            k = key[f : f + m]
            leader.append(np.full(m, k[_leaders(k, 1)[0]]))
            member.append(k)
        if leader:
            both = np.unique(np.stack([np.concatenate(leader), np.concatenate(member)]), axis=1)
            yield rows(["leader", "key"], [pa.int64(), pa.int64()], both[0], both[1])

    return dealt.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).mapInArrow(work, "leader long, key long").distinct()


def similar(sizes: tuple[np.ndarray, np.ndarray], codes: tuple[list[np.ndarray], list[np.ndarray]], percent: int) -> np.ndarray:
    """Which sets of one block are similar to which of another: counts of common shingles by products of their incidence matrices."""
    flat = [np.concatenate(c) for c in codes]
    both = np.intersect1d(*flat)
    rowsof = [np.repeat(np.arange(len(c)), [len(x) for x in c]) for c in codes]
    at = [np.searchsorted(both, f) for f in flat]
    hit = [both[np.minimum(a, len(both) - 1)] == f if len(both) else np.zeros(len(f), bool) for a, f in zip(at, flat, strict=True)]
    common = np.zeros((len(codes[0]), len(codes[1])), np.float32)
    for lo in range(0, len(both), COLUMNS):
        m = []
        for r, a, h, c in zip(rowsof, at, hit, codes, strict=True):
            k = h & (a >= lo) & (a < lo + COLUMNS)
            d = np.zeros((len(c), min(COLUMNS, len(both) - lo)), np.float32)
            d[r[k], a[k] - lo] = 1
            m.append(d)
        common += m[0] @ m[1].T
    common = common.astype(np.int64)
    return 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)


def across(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between components that the first round left apart: enough of them to join all that are similar.

    A cluster of one component alone is done. Else a component of some size has blocks of its own, small ones share blocks,
    and blocks meet in pairs, but not those of the same component.
    """
    m = members.join(labels, members["key"] == labels["node"], "left").select("leader", "key", F.coalesce("component", "key").alias("component"))
    open_ = m.groupBy("leader").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("leader")
    m = stored(m.join(open_, "leader"), "members")
    own = m.groupBy("leader", "component").agg(F.count("*").alias("c")).select("leader", "component", F.when(F.col("c") > BLOCK // 4, F.col("component")).alias("part"))
    m = m.join(own, ["leader", "component"])
    many = m.groupBy("leader", "part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).select(F.col("leader").alias("l2"), F.col("part").alias("p2"), "blocks")
    m = m.join(many, (m["leader"] == many["l2"]) & m["part"].eqNullSafe(many["p2"]))
    m = stored(m.select("leader", "key", "component", "part", F.xxhash64("leader", "part", F.pmod(F.xxhash64("key"), "blocks")).alias("block")), "blocks")
    block = m.groupBy("leader", "part", "block").agg(F.lit(1).alias("one"))
    x, y = block.select("leader", F.col("part").alias("pa"), F.col("block").alias("ba")), block.select("leader", F.col("part").alias("pb"), F.col("block").alias("bb"))
    meet = x.join(y, "leader").where((F.col("ba") <= F.col("bb")) & (F.col("pa").isNull() | F.col("pb").isNull() | (F.col("pa") != F.col("pb")))).select("leader", "ba", "bb")
    first = m.join(meet, (m["leader"] == meet["leader"]) & (m["block"] == meet["ba"])).select("key", "component", "ba", "bb", F.lit(0).alias("side"))
    second = m.join(meet, (m["leader"] == meet["leader"]) & (m["block"] == meet["bb"]) & (meet["ba"] != meet["bb"])).select("key", "component", "ba", "bb", F.lit(1).alias("side"))
    sent = first.unionByName(second).join(sets.select("key", "size", "many", "codes"), "key")

    def compare(table):
        side = table.column("side").to_numpy()
        key, comp, size, many = (table.column(c).to_numpy() for c in ("key", "component", "size", "many"))
        codes = [unpack(d, k, "u8")[0] for d, k in zip(table.column("codes").to_pylist(), many.tolist(), strict=True)]
        one = np.flatnonzero(side == 0)
        two = np.flatnonzero(side == 1) if (side == 1).any() else one
        out: list[tuple[int, int]] = []
        if len(one) and len(two):
            ok = similar((size[one], size[two]), ([codes[i] for i in one], [codes[i] for i in two]), percent) & (comp[one][:, None] != comp[two][None, :])
            top: dict[int, int] = {}

            def find(c: int) -> int:
                while top.get(c, c) != c:
                    c = top[c]
                return c

            for i, j in zip(*np.nonzero(ok), strict=True):  # those that join what was apart
                p, q = find(int(comp[one[i]])), find(int(comp[two[j]]))
                if p != q:
                    top[max(p, q)] = min(p, q)
                    out.append((int(key[one[i]]), int(key[two[j]])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return sent.groupBy("ba", "bb").applyInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of classes with 100 |a and b| >= percent |a or b|."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for sa, ma, da, sb, mb, db in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                x, y = unpack(da, ma, "u8")[0], unpack(db, mb, "u8")[0]
                i = np.searchsorted(y, x)
                both = int((y[np.minimum(i, mb - 1)] == x).sum())
                keep.append(100 * both >= percent * (sa + sb - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("key").alias("a"), F.col("size").alias("sa"), F.col("many").alias("ma"), F.col("codes").alias("da"))
    two = sets.select(F.col("key").alias("b"), F.col("size").alias("sb"), F.col("many").alias("mb"), F.col("codes").alias("db"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "ma", "da", "sb", "mb", "db").mapInArrow(work, "a long, b long")


def _sets(made: DataFrame, n: int) -> DataFrame:
    """(key, many, codes, data): a class's shared shingles, ascending, packed alone and with their counts."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(data, size, "i8", "u4", "u4", "u4") for b in batches for size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if not parts:
            return
        key, top, bucket, count = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        code = bucket.astype(np.uint64) << np.uint64(32) | top
        o = np.lexsort((code, key))
        key, code, count = key[o], code[o], count[o]
        s = starts_of(key)
        ends = ends_of(s, len(key))
        for i in range(0, len(s), 2000):
            span = list(zip(s[i : i + 2000], ends[i : i + 2000], strict=True))
            yield rows(["key", "many", "codes", "data"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], key[s[i : i + 2000]], [e - a for a, e in span], [pack(code[a:e]) for a, e in span], [pack(count[a:e]) for a, e in span])

    return made.where("kind = 0").repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).select("size", "data").mapInArrow(unite, "key long, many int, codes binary, data binary")


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: doc_id, set_size, key), (links: a, b between classes, enough for all components), (labels: key, component of keys) of all documents."""
    n = n_parts(docs.sparkSession)
    made = stored(counted(docs, n, id_col, text_col), "shingles")
    members = _members(made)
    classes = members.where("set_size > 0").groupBy("key").agg(F.first("set_size").alias("size"))
    # with more shingles of its own than any partner may lack, a class has no partner: its prefix holds none that is shared
    sets = classes.join(_sets(made, n), "key").where(F.col("size") - F.col("many") <= F.col("size") - F.ceil(F.col("size") * percent / 100))
    sets = stored(sets, "sets")
    dealt = stored(postings(sets, n, percent), "postings")
    links = stored(verified(matches(dealt, n, percent), sets, percent), "links")
    labels = stored(components(links), "labels")
    more = stored(across(clusters(dealt, n), sets, labels, percent), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = stored(components(links), "labels")
    return members, links, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_id (smallest doc_id with the same set).

    Null, empty and wordless texts have no shingles and link with nothing: each is its own component. A text of fewer than five words is one shingle.
    Repeated rows are links of their own id. A null id is reported as null and, being the smallest, makes its component's id null. Empty tables give no rows. Texts are read whole; other columns are not read.
    """
    members, _, labels = join_classes(docs, id_col, text_col, percent)
    # a component's smallest id: by class first, then over the component's classes
    least = members.where("set_size > 0").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    named = least.join(labels, least["key"] == labels["node"], "left")
    named = named.select("key", "class_id", F.coalesce("component", "key").alias("component"))
    smallest = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(smallest, "component").select(F.col("key").alias("k"), "class_id", "component_id")
    out = members.join(named, (members["key"] == named["k"]) & (members["set_size"] > 0), "left")
    null = F.lit(-(1 << 63))  # stands for a null id
    return out.select(
        F.nullif("doc_id", null).alias("doc_id"),
        F.col("set_size").alias("n_shingles"),
        F.nullif(F.coalesce("component_id", "doc_id"), null).alias("component_id"),
        F.nullif(F.coalesce("class_id", "doc_id"), null).alias("class_id"),
    )
