"""Secret scans over a trigram inverted index, in DataFrame functions alone.

1. From each rule's regular expression a Boolean query over trigrams is derived:
   an OR of ANDs of three-character strings that any match must contain.
2. An inverted index holds, for each trigram that some query asks for, the
   documents with it.
3. The postings are intersected and united per document; what passes a rule's
   query is its candidate.
4. Candidates alone are scanned by the rule. A rule whose expression has no
   mandatory trigram scans every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre  # the standard library's own parser of regular expressions
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Of the matches of pattern (leftmost, not overlapping), those whose group has at least min_length characters count."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0


# fixed values: the base rules
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# more kinds that the index makes cheap: each has mandatory trigrams
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
DEFAULT_RULES = BASE_RULES + MORE_RULES

#: Of an expression's finite string sets, as many strings are followed exactly; a larger set is let go (which only widens the query).
SET_LIMIT = 32

# A query is a frozenset of ANDs, each a frozenset of trigrams; {frozenset()} is true for every text.
ANY = frozenset([frozenset()])


def _simplify(query: frozenset) -> frozenset:
    """Drops ANDs that another, weaker AND implies."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _and(p: frozenset, q: frozenset) -> frozenset:
    both = _simplify(frozenset(a | b for a in p for b in q))
    return both if len(both) <= SET_LIMIT else min(p, q, key=len)


def _or(queries: list[frozenset]) -> frozenset:
    either = _simplify(frozenset().union(*queries))
    return either if len(either) <= SET_LIMIT else ANY


def _grams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _of_set(strings: frozenset) -> frozenset:
    return _or([frozenset([_grams(s)]) for s in strings])


def _exact(node) -> frozenset | None:
    """The finite set of strings (letters lower-cased) that one parsed item can match, or None."""
    op, arg = node
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()])
    if op is sre.IN:
        out = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < SET_LIMIT:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return frozenset(out) if len(out) <= SET_LIMIT // 4 else None
    if op is sre.SUBPATTERN:
        return _exact_seq(arg[3])
    if op is sre.BRANCH:
        sets = [_exact_seq(x) for x in arg[1]]
        return None if None in sets else frozenset().union(*sets)
    if op is sre.AT:
        return frozenset([""])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        one = _exact_seq(body)
        if one is None or high is sre.MAXREPEAT or high > 8:
            return None
        out, part = set(), frozenset([""])
        for n in range(high + 1):
            if n >= low:
                out |= part
            part = frozenset(a + b for a in part for b in one)
            if len(part) > SET_LIMIT:
                return None
        return frozenset(out) if len(out) <= SET_LIMIT else None
    return None


def _exact_seq(items) -> frozenset | None:
    out = frozenset([""])
    for x in items:
        s = _exact(x)
        if s is None:
            return None
        out = frozenset(a + b for a in out for b in s)
        if len(out) > SET_LIMIT:
            return None
    return out


def _query(items) -> frozenset:
    """The query of a sequence: its runs of finite items give trigrams across item borders, all else its own query."""
    query, run = ANY, frozenset([""])
    for x in items:
        s = _exact(x)
        if s is not None and len(longer := frozenset(a + b for a in run for b in s)) <= SET_LIMIT:
            run = longer
            continue
        query, run = _and(query, _of_set(run)), s or frozenset([""])
        if s is None:
            op, arg = x
            if op is sre.SUBPATTERN:
                query = _and(query, _query(arg[3]))
            elif op is sre.BRANCH:
                query = _and(query, _or([_query(b) for b in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                query = _and(query, _query(arg[2]))
    return _and(query, _of_set(run))


def trigram_query(pattern: str) -> frozenset:
    """ANDs (sets of lower-cased trigrams), one of which every text with a match contains whole; {empty set} if nothing is mandatory."""
    return _query(_parser.parse(pattern))


def trigram_postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index for these trigrams: (gram, id) for each document whose lower-cased text has the trigram.

    Null texts have no trigrams. Postings of trigrams that no query reads are not made.
    """
    low = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"))
    held = F.filter(F.array(*[F.lit(t) for t in sorted(trigrams)]), lambda t: F.contains(F.col("low"), t))
    return low.select("id", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kinds): the kinds whose Boolean query a document's postings fulfil. Rules without mandatory trigrams are not in it."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    grams = sorted({g for q in queries.values() for a in q for g in a})
    if not grams:
        return docs.select(F.col(id_col).alias("id")).limit(0).withColumn("kinds", F.array().cast("array<string>"))
    held = trigram_postings(docs, grams, id_col, text_col).groupBy("id").agg(F.collect_set("gram").alias("held"))

    def fulfils(query: frozenset) -> Column:
        out = F.lit(False)
        for part in sorted(map(sorted, query)):
            out = out | (F.size(F.array_intersect("held", F.array(*[F.lit(g) for g in part]))) == len(part))
        return out

    kinds = F.filter(F.array(*[F.when(fulfils(q), F.lit(k)) for k, q in queries.items()]), lambda k: k.isNotNull())
    return held.select("id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, order of the kind, end, kind) of a rule's matches in code points, end exclusive.

    What lies between matches comes from split, the matches from regexp_extract_all; both walk the same
    leftmost matches, so a start is the length of all pieces and matches before it.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(
        F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)), lambda p: F.length(p)).alias("gap"),
        F.transform(found, lambda m: F.length(m)).alias("len"),
        F.transform(group, lambda m: F.length(m)).alias("glen"),
    )
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + p["len"]).alias("at"),
            F.when(p["glen"] < rule.min_length, acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["len"]).alias("end"))))).alias("spans"),
        ),
    )
    return walked["spans"]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and spans, array of (start, ord, end, kind) by start, then by the rules' order.

    Null text counts as empty and has no spans, empty texts neither; repeated rows and repeated
    or null ids give a row each; other columns are left out, whatever their names. Offsets are code points, ends exclusive.
    The whole text is scanned, however long.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = candidates(d, rules, "id", "text").withColumnRenamed("id", "cid")
    d = d.join(found, d["id"].eqNullSafe(found["cid"]), "left").select("id", "text", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for n, r in enumerate(rules):
        # a rule without mandatory trigrams scans every text: one pass of the regex decides whether spans have to be worked out
        mandatory = trigram_query(r.pattern) != ANY
        wanted = F.array_contains("kinds", r.kind) if mandatory else F.col("text").rlike(_at_least(r))
        spans = F.when(wanted, _spans(F.col("text"), r)).otherwise(none)
        parts.append(F.transform(spans, _labelled(n, r.kind)))
    return d.select(F.col("id").alias(id_col), F.array_sort(F.concat(*parts)).alias("spans"))


def _labelled(order: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _at_least(rule: Rule) -> str:
    """For a lone repeated class, the expression of matches that are long enough; else the rule's own."""
    tree = list(_parser.parse(rule.pattern))
    lone = len(tree) == 1 and tree[0][0] is sre.MAX_REPEAT and rule.pattern.endswith("+") and not rule.group
    return f"{rule.pattern[:-1]}{{{rule.min_length}}}" if lone and rule.min_length else rule.pattern


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query, from scan_secrets with the default rules."""
    base = [r.kind for r in BASE_RULES]
    s = scan_secrets(docs)
    kept = F.filter("spans", lambda x: x["ord"] < len(base))
    return s.select(
        "doc_id",
        *[F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(as_text(kept), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )
