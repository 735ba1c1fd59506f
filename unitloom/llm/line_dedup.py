"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line's tokens are its distinct runs of N words; a shorter line is one token of all its words. Lines with
the same tokens are one class, told by two digests. Tokens are ordered by rarity; two lines of Jaccard >= t share a
token among the first |x| - ceil(t |x|) + 1 of each, their prefixes. Classes that share one meet; length and position
bounds drop some, what both prefixes have in common most of the others, and the token sets of what is left are
read from the texts again and compared. A line is removed if an equal or similar line comes earlier.

Of a token's list each class first meets the NEAREST classes before it. Only classes that this leaves standing,
and only in longer lists, then meet all that come before: a large group of near copies is not spread into its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Words of a token, similarity.
N, PERCENT = 5, 80
#: Classes before it that a class meets at first, in each list.
NEAREST = 10
#: Counters of the rarity sketch: its size is fixed, whatever the corpus.
COUNTERS = 1 << 15
#: Bits of a token by which lists are told apart; its class of rarity stands above them. Sets are compared by all 64.
TOKEN_BITS = 58
#: Bits of the filter by which lines are looked up again.
BITS = 1 << 22
#: Runs of a line that are written out one by one, so many at a time. Any numbers give the same result.
UNROLLED, BLOCK = 256, 32
#: White space within lines: all of it cuts words.
_SPACES = "\t\x0b\x0c\r"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, text): row tells input rows apart, doc is the id (nulls the smallest)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), text.alias("text"))


def _evened(rows: DataFrame) -> DataFrame:
    """rows with the text in lower case, all white space but line ends a space."""
    others = [F.contains("text", F.lit(c)) for c in _SPACES]
    spaced = F.when(others[0] | others[1] | others[2] | others[3], F.regexp_replace("text", f"[{_SPACES}]", " ")).otherwise(F.col("text"))
    return rows.withColumn("text", F.lower(spaced))


def _lines(rows: DataFrame) -> DataFrame:
    """(row, doc, pos, line): lines that have words, evened."""
    return _evened(rows).select("row", "doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.trim("line") != "")


def _words() -> Column:
    """A line's words in order."""
    return F.array_remove(F.split("line", " "), "")


def _hashed(lines: DataFrame) -> DataFrame:
    """lines with h, 64-bit hashes of their words in order."""
    return lines.withColumn("h", F.transform(_words(), lambda w: F.xxhash64(w)))


def _places() -> Column:
    """Where runs of N words begin; one run for a line of fewer."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("h") - N))


def _run(h: Column | str, i: Column) -> Column:
    """The run's 64-bit hash; words beyond the line's end are left out."""
    return F.xxhash64(*[F.get(h, i + k) for k in range(N)])


def rarity(rows: DataFrame) -> Column:
    """The class of rarity of each counter, 0 the rarest, above TOKEN_BITS bits, as an array: counts of the tokens of all lines in COUNTERS counters.

    A counter's class is how far it lies above the mean, in steps of four times the deviation that chance gives it. Any classes give the same result.
    """
    h = _hashed(_lines(rows)).select("h", F.explode(_places()).alias("i"))
    found = h.select(_counter(_run("h", F.col("i"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    n = {r.c: r.n for r in found.collect()}  # COUNTERS rows at most
    mean = sum(n.values()) / COUNTERS
    step = 4 * mean**0.5 + 1
    high = {c: min(31, int((k - mean) / step).bit_length()) for c, k in n.items() if k >= mean + step}
    return F.split(F.lit(",".join(str(high.get(i, 0) << TOKEN_BITS) for i in range(COUNTERS))), ",").cast("array<bigint>")  # folds to one literal


def _tokens(h: str) -> Column:
    """Hashes of all runs of words.

    Lambdas are interpreted for each element, so the first UNROLLED runs are written out, which is compiled: a BLOCK of them for
    each that the line reaches into. What a longer line has beyond them goes through a lambda.
    """
    run = "xxhash64(" + ", ".join(f"get({h}, {{0}} + {k})" for k in range(N)) + ")"
    parts = [f"if({o} = 0 or size({h}) >= {o + N}, array({', '.join(run.format(i) for i in range(o, o + BLOCK))}), array())" for o in range(0, UNROLLED, BLOCK)]
    rest = f"if(size({h}) >= {UNROLLED + N}, flatten(transform(array({h}), {h} -> transform(sequence({UNROLLED}, size({h}) - {N}), i -> {run.format('i')}))), array())"
    return F.expr(f"slice(concat({', '.join(parts)}, {rest}), 1, greatest(1, size({h}) - {N - 1}))")


def _counter(token: Column) -> Column:
    return token.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")


def _with_prefix(t: DataFrame, classes: Column) -> DataFrame:
    """t with prefix, the length rarest of toks (ascending), as numbers that sort by class of rarity, then by hash.

    Those of class 0 among the first serve if they are enough, else all are sorted by class.
    """
    some = F.when(F.col("length") == 0, 0).otherwise((F.col("length") * 5 / 4).cast("int") + 4)
    t = t.withColumn("first", F.filter(F.slice("toks", F.lit(1), some), lambda x: F.get(classes, _counter(x)) == 0))
    # never null, so that they are sorted as plain numbers
    every = F.sort_array(F.transform("toks", lambda x: F.coalesce(F.get(classes, _counter(x)) + F.shiftright(x, 64 - TOKEN_BITS), F.lit(0))))
    rare = F.transform(F.slice("first", F.lit(1), "length"), lambda x: F.shiftright(x, 64 - TOKEN_BITS))
    return t.withColumn("prefix", F.when(F.size("first") >= F.col("length"), rare).otherwise(F.slice(every, F.lit(1), "length")))


def token_sets(lines: DataFrame) -> DataFrame:
    """lines with toks, distinct and ascending, and cls and alt, two digests that tell token sets apart.

    A line of one token is told by a digest of its words as well: short lines are many, and a hash of 64 bits alone would in time unite some.
    """
    t = _hashed(lines).withColumn("toks", F.sort_array(F.array_distinct(_tokens("h")))).drop("h")
    whole = F.when(F.size("toks") == 1, F.xxhash64(F.lit(2), F.slice(_words(), 1, N))).otherwise(F.xxhash64(F.lit(1), "toks"))
    return t.withColumn("cls", F.xxhash64("toks")).withColumn("alt", whole)


def _least_common(n: Column | str, percent: int) -> Column:
    """The fewest tokens that a line of n shares with a similar one."""
    return F.ceil(F.col(n) * percent / 100).cast("int")


def tokenized(rows: DataFrame, classes: Column, percent: int = PERCENT) -> DataFrame:
    """(row, doc, pos, cls, alt, n, prefix) of each line that has words. Sets so small that none but an equal one is similar have no prefix."""
    t = token_sets(_lines(rows)).withColumn("n", F.size("toks"))
    t = t.withColumn("length", F.when(100 * F.col("n") >= percent * (F.col("n") + 1), F.col("n") - _least_common("n", percent) + 1).otherwise(0))
    return _with_prefix(t, classes).select("row", "doc", "pos", "cls", "alt", "n", "prefix")


def _one_each(t: DataFrame, repeated: DataFrame) -> DataFrame:
    """(cls, n, prefix): a row for each class that has a prefix. Most lines are alone in theirs, which a filter of fixed size tells; the others are united."""
    t = t.where(F.size("prefix") > 0).select("cls", "n", "prefix")
    bits = stored(_filter(repeated.select(F.col("cls").alias("key"))), "repeated")
    several = _among(t, F.col("cls"), bits).groupBy("cls").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    return _among(t, F.col("cls"), bits, False).unionByName(several)


def postings(firsts: DataFrame) -> DataFrame:
    """(tok, cls, i, c): each class once in the list of each token of its prefix, i its place there, for lists of c > 1 classes.

    i is 127 at most, which only loosens the bound it is used in.
    """
    p = firsts.select("cls", F.posexplode("prefix").alias("i", "tok")).select("tok", "cls", F.least("i", F.lit(127)).cast("byte").alias("i"))
    return p.withColumn("c", F.count("*").over(Window.partitionBy("tok"))).where("c > 1")


def _by_length(percent: int) -> Column:
    """Length and position bounds for (n, i) and (yn, yi), places of a token in both, the first that both share."""
    small, large = F.least("n", "yn"), F.greatest("n", "yn")
    most = F.least(F.col("n") - F.col("i"), F.col("yn") - F.col("yi"))
    return (100 * small >= percent * large) & (most * (100 + percent) >= percent * (F.col("n") + F.col("yn")))


def _by_prefixes(percent: int) -> Column:
    """A bound for (n, prefix) and (yn, yprefix): up to the earlier of both prefixes' ends all common tokens are seen, beyond it lies what the line that ends there has left."""
    last, y_last = F.get("prefix", F.size("prefix") - 1), F.get("yprefix", F.size("yprefix") - 1)
    beyond = F.when(last <= y_last, F.col("n") - F.size("prefix")).otherwise(F.col("yn") - F.size("yprefix"))
    return (F.size(F.array_intersect("prefix", "yprefix")) + beyond) * (100 + percent) >= percent * (F.col("n") + F.col("yn"))


def _among(df: DataFrame, key: Column, words: DataFrame, wanted: bool = True) -> DataFrame:
    """df's rows whose key may be among those that words (of _filter) has, or those whose key is not: a join with a table of fixed size at most."""
    k = F.pmod(key, F.lit(BITS))
    d = df.withColumn("_w", F.shiftright(k, 6)).withColumn("_b", k.bitwiseAND(F.lit(63)).cast("int"))
    d = d.join(F.broadcast(words), d["_w"] == words["w"], "inner" if wanted else "left")
    return d.where(F.coalesce(F.getbit("bits", F.col("_b")), F.lit(0)) == int(wanted)).select(*df.columns)


def _filter(keys: DataFrame) -> DataFrame:
    """(w, bits): a bit for each key in BITS bits, words of 64 that have any: BITS / 64 rows at most, which bounds what is broadcast."""
    k = keys.select(F.pmod("key", F.lit(BITS)).alias("k"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k").bitwiseAND(F.lit(63)).cast("int"))
    return k.groupBy(F.shiftright("k", 6).alias("w")).agg(F.bit_or(one).alias("bits"))


def _sets_of(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(cls, toks) of the wanted classes (cls, at, the place of a line of it), their lines read again and cut as before.

    A filter of fixed size spares the others the work, and the join behind it is exact.
    """
    doc, place = F.xxhash64("doc"), F.xxhash64("doc", "pos")
    pos = F.pmod("at", F.lit(1 << 31))
    w = wanted.select(((F.col("at") - pos) / F.lit(1 << 31)).cast("decimal(38,0)").cast("long").alias("doc"), pos.cast("int").alias("pos"))
    bits = stored(_filter(w.select(doc.alias("key")).union(w.select(place.alias("key")))), "places")
    t = _among(_lines(_among(rows, doc, bits)), place, bits)
    t = token_sets(t).select("cls", "toks").join(wanted.select("cls").distinct(), "cls", "left_semi")
    return stored(t.groupBy("cls").agg(F.first("toks").alias("toks")), "sets")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x of the pairs (x, y) of classes whose token sets are similar."""
    a, b = sets.select(F.col("cls").alias("x"), F.col("toks").alias("tx")), sets.select(F.col("cls").alias("y"), F.col("toks").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty"))
    j = pairs.join(a, "x").join(b, "y")
    return j.where(100 * both >= percent * (F.size("tx") + F.size("ty") - both)).select("x").distinct()


def similar_to_earlier(sets: DataFrame, firsts: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(x): classes whose first line has a similar line of another class before it. sets: (cls, n, prefix), firsts: (cls, at)."""
    q = stored(postings(sets), "lists")
    known = stored(sets.join(q.select("cls").distinct(), "cls", "left_semi").join(firsts.select("cls", "at"), "cls").select("cls", "at", "n", "prefix"), "known")
    member = stored(q.join(known.drop("prefix"), "cls"), "members")
    discard(q)
    y_known = known.select(F.col("cls").alias("y"), F.col("n").alias("yn"), F.col("prefix").alias("yprefix"))

    def found(pairs: DataFrame) -> DataFrame:
        p = stored(pairs, "pairs")
        wanted = known.join(p.select(F.explode(F.array("x", "y")).alias("cls")).distinct(), "cls", "left_semi").select("cls", "at")
        return stored(_similar(p, _sets_of(wanted, rows), percent), "found")

    before = Window.partitionBy("tok").orderBy("at", "cls").rowsBetween(-NEAREST, -1)
    near = member.withColumn("y", F.collect_list(F.struct("cls", "n", "i")).over(before)).select("cls", "n", "i", F.explode("y").alias("y"))
    near = near.select("cls", "n", "i", F.col("y.cls").alias("y"), F.col("y.n").alias("yn"), F.col("y.i").alias("yi")).where(_by_length(percent)).select("cls", "y").distinct()
    one = found(near.join(known.drop("at"), "cls").join(y_known, "y").where(_by_prefixes(percent)).select(F.col("cls").alias("x"), "y"))
    # what stands, in lists that are longer: a pair comes up at the first token that both share
    long_ = member.where(F.col("c") > NEAREST + 1).drop("c").join(known.select("cls", "prefix"), "cls")
    x = long_.join(one, long_["cls"] == one["x"], "left_anti")
    y = long_.select(*[F.col(c).alias("y" + c) for c in long_.columns])
    meet = (x["tok"] == y["ytok"]) & (x["cls"] != y["ycls"]) & (y["yat"] < x["at"]) & _by_length(percent)
    rest = x.join(y, meet & (F.get(F.array_intersect("prefix", "yprefix"), F.lit(0)) == F.col("tok")) & _by_prefixes(percent))
    return one.unionByName(found(rest.select(F.col("cls").alias("x"), F.col("ycls").alias("y")).distinct())).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(row, gone): for each input row (by the row of _rows) with lines to be removed, their places, ascending."""
    rows = _rows(docs, id_col, text_col)
    t = stored(tokenized(rows, rarity(rows), percent), "lines")
    # equal lines: all but the first; partial minima of plain numbers before the shuffle, and only classes that matter come back to the lines
    place = F.col("doc").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    firsts = t.select("cls", "alt", place.cast("decimal(38,0)").alias("at")).groupBy("cls", "alt").agg(F.min("at").alias("at"), F.count("*").alias("c"))
    firsts = stored(firsts, "firsts")
    earlier = similar_to_earlier(_one_each(t, firsts.where("c > 1")), firsts, rows, percent)
    t = t.select("row", "pos", "cls", "alt", place.cast("decimal(38,0)").alias("place"))
    earlier = earlier.select(F.col("x").alias("cls"), F.lit(True).alias("whole"))
    act = firsts.select("cls", "alt", "at", "c").join(earlier, "cls", "left").where((F.col("c") > 1) | F.col("whole"))
    act = act.select(F.col("cls").alias("k"), F.col("alt").alias("k2"), "at", F.coalesce("whole", F.lit(False)).alias("whole"))
    gone = t.join(act, (t["cls"] == act["k"]) & (t["alt"] == act["k2"])).where(F.col("whole") | (F.col("place") > F.col("at")))
    return gone.groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The input with two more columns: gone, places of the removed lines (empty array if none), and kept, the text of the others.

    Order is by id, then by place in the text. A line of fewer than N words is removed if an equal one (words and case apart from white space and
    capitals) comes earlier; lines without words stay, so do empty texts; a null text stays null.
    Rows with one id are one document's: the same line at the same place of repeated rows is no earlier line. Null ids come first.
    A text whose lines all go is the empty string. Texts and lines of any length are read whole. An empty table gives an empty one.
    Extra columns stay as they are, apart from any named gone or kept, which are replaced.
    """
    found = removed_lines(docs, id_col, text_col, percent).select(F.col("row").alias("_gone_row"), F.col("gone").alias("_gone"))
    text = docs[text_col]
    d = docs.join(found, F.xxhash64(docs[id_col], F.coalesce(text.cast("string"), F.lit(""))) == found["_gone_row"], "left")
    gone = F.coalesce(found["_gone"], F.array().cast("array<int>"))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    others = [docs[c] for c in docs.columns if c not in ("gone", "kept")]
    return d.select(*others, gone.alias("gone"), F.when(F.size(gone) == 0, text).otherwise(kept).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places, comma-joined): one row per input row."""
    gone = removed_lines(docs).withColumnRenamed("row", "grow")
    d = docs.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    d = d.join(gone, d["row"] == gone["grow"], "left")
    return d.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos - 1 AS pos, string_split(text, chr(10))[u.pos] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos) u
), words AS (
  SELECT doc_id, pos, list_filter(string_split(lower(regexp_replace(line, '[\t\x0B\x0C\r]', ' ', 'g')), ' '), lambda w: w <> '') AS w
  FROM lines
), toks AS (
  SELECT doc_id, pos, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i+4], ' ')))) AS t
  FROM words WHERE len(w) > 0
), classes AS (
  SELECT t, min(doc_id * 1000000 + pos) AS att, row_number() OVER () AS c FROM toks GROUP BY t
), posted AS (SELECT c, att, len(t) AS n, unnest(t) AS tok FROM classes
), common AS (
  SELECT x.c AS c FROM posted x JOIN posted y ON x.tok = y.tok AND y.att < x.att
  GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), gone AS (
  SELECT doc_id, pos FROM toks JOIN classes USING (t)
  WHERE doc_id * 1000000 + pos > att OR c IN (SELECT c FROM common)
)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
  CAST(count(g.pos) AS BIGINT) AS n_removed, coalesce(string_agg(CAST(g.pos AS VARCHAR), ',' ORDER BY g.pos), '') AS removed
FROM documents d LEFT JOIN gone g USING (doc_id) GROUP BY d.doc_id, d.text
"""
