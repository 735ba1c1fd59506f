"""URL filters by cascades of Bloom filters.

Level 1 holds the listed keys. Of the corpus's complete key universe, the keys
that are not listed but pass level 1 go into level 2; listed keys that pass
level 2 go into level 3, and so on until no false positive is left. Within
the universe the cascade then answers exactly, and a page is judged without a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Bits for each key of a level, and hash functions.
BITS, HASHES = 10, 7
#: A cascade is broadcast up to so many bytes in all; beyond that pages meet the rules by a join.
BROADCAST_BYTES = 64 << 20
_WORD = 1 << 16  # bits in one row while a level is put together

# fixed values: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or without '://'."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Each pair of a suffix of the host at a label's border and a start of the path, the starts as long as some rule's path; longest first."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.struct((-F.length(s) - F.length(p)).alias("neg"), (-F.length(s)).alias("hneg"), s.alias("host"), p.alias("path")))))
    return F.array_sort(F.array_distinct(pairs))


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each key: double hashing of its 64 bits."""
    h = hashes.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


@dataclass
class Level:
    bits: int
    data: np.ndarray  # a byte for eight bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        p = _positions(hashes, self.bits)
        return ((self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(1) if len(p) else np.zeros(0, bool)


def key_hash(level: int) -> Column:
    return F.xxhash64("host", "path", F.lit(level))


def build_level(keys: DataFrame, number: int, count: int) -> Level:
    """Tasks set bits of their own keys; rows of the same stretch of bits are united before they come to the driver."""
    bits = max(64, BITS * count)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            p = _positions(b.column(0).to_numpy(), bits).ravel()
            for w in np.unique(p // _WORD):
                row = own.setdefault(int(w), np.zeros(_WORD // 8, np.uint8))
                at = (p[p // _WORD == w] % _WORD).astype(np.int64)
                np.bitwise_or.at(row, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(own), pa.int64()), "data": pa.array([v.tobytes() for v in own.values()], pa.binary())})

    def unite(key, table):
        rows = [np.frombuffer(x.as_py(), np.uint8) for x in table.column("data")]
        return pa.table({"word": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

    parts = keys.select(key_hash(number).alias("h")).mapInArrow(partial, "word long, data binary")
    data = np.zeros((bits + _WORD - 1) // _WORD * (_WORD // 8), np.uint8)
    for r in parts.groupBy("word").applyInArrow(unite, "word long, data binary").collect():  # BITS bits for each listed key
        data[r.word * (_WORD // 8) : (r.word + 1) * (_WORD // 8)] = np.frombuffer(r.data, np.uint8)
    return Level(bits, data)


def passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.has(b.column(2).to_numpy())))

    return keys.select("host", "path", key_hash(number).alias("h")).mapInArrow(keep, "host string, path string, h long").select("host", "path")


def build_cascade(listed: DataFrame, others: DataFrame, limit: int = BROADCAST_BYTES) -> list[Level] | None:
    """Levels for listed against all other keys of the universe; None if they outgrow the limit."""
    levels: list[Level] = []
    mine, theirs = listed, others
    size = 0
    while count := mine.count():
        size += BITS * count // 8
        if size > limit:
            return None
        levels.append(build_level(mine, len(levels), count))
        wrong = stored(passing(theirs, levels[-1], len(levels) - 1), f"level{len(levels)}")
        mine, theirs = wrong, mine
    return levels


def member(levels: list[Level], hashes: list[np.ndarray]) -> np.ndarray:
    """Whether keys are listed: the first level that a key fails decides, and one that passes all is of the last level's kind."""
    n = len(hashes[0]) if hashes else 0
    out, open_ = np.zeros(n, bool), np.ones(n, bool)
    for i, level in enumerate(levels):
        ok = level.has(hashes[i])
        out[open_ & ~ok] = i % 2 == 1
        open_ &= ok
    out[open_] = len(levels) % 2 == 1
    return out


RESULT = "page_id long, host string, path string, rule string, verdict string"


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: host, path, the longest rule that fits (null if none does) and verdict, allow where no rule fits.

    rules: verdict (block or allow), host, path; repeated rules count once, and of two rules with the same key block wins. A rule fits its host
    and all its subdomains if the path starts with its path. Of rules as long, the one with the longer host wins.
    Null urls and those without '://' have an empty host and path. Rows that repeat are each judged. No rules or no pages: nothing fits, no rows.
    Columns other than the two named are not read. The driver gets the distinct lengths of rule paths and the cascade, whose size is checked.
    """
    spark = pages.sparkSession
    rules = rules.select(F.col("verdict"), ascii_lower(F.col("host")).alias("host"), F.col("path")).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    p = p.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<struct<neg:int,hneg:int,host:string,path:string>>"))
    universe = stored(p.select(F.explode("keys").alias("k")).select("k.host", "k.path").distinct(), "keys")
    marked = stored(universe.join(rules, ["host", "path"], "left"), "marked")  # of distinct keys, once, to build the cascades
    cascades = {}
    for verdict in ("block", "allow"):
        listed = marked.where(F.col("verdict") == verdict).select("host", "path")
        others = marked.where(~F.col("verdict").eqNullSafe(F.lit(verdict))).select("host", "path")
        cascades[verdict] = build_cascade(listed, others, limit)
    if None in cascades.values():
        return _by_join(p, rules)
    depth = max(len(c) for c in cascades.values())
    held = spark.sparkContext.broadcast(cascades)
    hashes = [F.transform("keys", _hash_at(i)).alias(f"h{i}") for i in range(max(1, depth))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            firsts = lists.offsets.to_numpy()
            firsts = firsts - firsts[0]
            flat = [b.column(4 + i).flatten().to_numpy() for i in range(max(1, depth))]
            hit = {v: member(c, flat[: len(c)]) if c else np.zeros(len(flat[0]), bool) for v, c in held.value.items()}
            any_hit = hit["block"] | hit["allow"]
            names = lists.flatten()
            rule, verdict = [], []
            where = np.flatnonzero(any_hit)
            first = np.searchsorted(where, firsts[:-1])
            for i in range(b.num_rows):  # keys are longest first, so the first hit is the rule
                at = where[first[i]] if first[i] < len(where) and where[first[i]] < firsts[i + 1] else -1
                rule.append(None if at < 0 else names[int(at)].as_py())
                verdict.append("block" if at >= 0 and hit["block"][at] else "allow")
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    names = F.transform("keys", lambda k: F.concat(k["host"], k["path"])).alias("names")
    return p.select("page_id", "host", "path", names, *hashes).mapInArrow(judge, RESULT)


def _hash_at(level: int):
    return lambda k: F.xxhash64(k["host"], k["path"], F.lit(level))


def _by_join(p: DataFrame, rules: DataFrame) -> DataFrame:
    """The same rows where the rules are too many for a broadcast."""
    p = p.withColumn("_row", F.monotonically_increasing_id())
    p = stored(p, "pages")
    hits = p.select("_row", F.posexplode("keys").alias("pos", "k")).join(rules, (F.col("k.host") == rules["host"]) & (F.col("k.path") == rules["path"]))
    best = hits.groupBy("_row").agg(F.min(F.struct("pos", F.concat("k.host", "k.path").alias("rule"), "verdict")).alias("best"))
    return p.join(best, "_row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
