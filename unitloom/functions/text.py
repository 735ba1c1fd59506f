"""Text segmentation, symbols and identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
CONTROL = r"\b(if|for|while|switch|goto|return|break|continue)\b"
LABEL = r"^\s*LABEL_\d+\s*:\s*$"
HEX = r"\b0[xX]([0-9a-fA-F]+)(?:[uULl]+)?\b"
STRING = r'"([^"\\]*(?:\\.[^"\\]*)*)"'
DEREF = r"\*\s*\(\s*(_?(?:BYTE|WORD|DWORD|QWORD|OWORD|TBYTE))\s*\*?\s*\*?\s*\)"
NUMBER = r"\b(0[xX][0-9a-fA-F]+|\d+)\b"
CALL = r"\b([A-Za-z_]\w{2,})\s*\("
HEX_NOISE = ("0", "1", "2", "3", "4", "5", "6", "7", "8", "f", "ff", "fff", "ffff")
COMMON = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 16, 20, 24, 31, 32, 48, 63, 64, 96, 100, 127, 128, 200, 255, 256, 512, 1000, 1024, 2048, 4096, 8192, 16384, 32768, 65535, 65536)
CALL_WORDS = ("if", "for", "while", "switch", "return", "sizeof", "else", "do", "goto", "__fastcall", "__cdecl", "__int64", "unsigned", "int", "char", "void")
LABELS = ("NO_MATCH", "HOST_MATCH", "INLINE_MATCH")
WRAP = 4096


def ascii_only(c: Column) -> Column:
    """Characters beyond ASCII as '_': word borders then mean the same in all regular expression dialects."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "_")


def split_blocks(lines: DataFrame) -> DataFrame:
    """Adds bb_id to lines (func, line_index, line, line_ea); inert brace lines are dropped.

    A label line opens a block, a line with a control word closes its own. Block numbers start at 0.
    """
    inert = F.col("line").rlike(r"[{};]") & F.col("line").rlike(r"^[\s{};]+$") & (F.coalesce("line_ea", F.lit("")) == "")
    w = Window.partitionBy("func").orderBy("line_index")
    kept = lines.where(~F.coalesce(inert, F.lit(False)))
    closes = ascii_only(F.coalesce("line", F.lit(""))).rlike(CONTROL)
    opens = F.coalesce(F.col("line"), F.lit("")).rlike(LABEL) | F.coalesce(F.lag(closes).over(w), F.lit(False))
    d = kept.withColumn("_open", opens.cast("int")).withColumn("_block", F.sum("_open").over(w))
    return d.withColumn("bb_id", F.dense_rank().over(Window.partitionBy("func").orderBy("_block")) - 1).drop("_open", "_block")


def block_anchors(blocks: DataFrame) -> DataFrame:
    """(func, bb_id, channel, token): distinct symbols of each block in four channels."""
    line = ascii_only(F.coalesce("line", F.lit("")))

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(line, F.lit(pattern), F.lit(1))

    def hex_token(x: Column) -> Column:
        t = F.ltrim(F.lower(x), F.lit("0"))
        return F.when(t == "", "0").otherwise(t)

    hexes = F.transform(F.filter(F.transform(found(HEX), hex_token), lambda t: ~t.isin(*HEX_NOISE)), lambda t: F.concat(F.lit("0x"), t))
    strings = F.filter(found(STRING), lambda s: F.length(s) >= 4)
    channels = {"CONTROL_KEYWORDS": found(CONTROL), "CONST_HEX": hexes, "DEREF_PATTERN": found(DEREF), "STRING_LIT": strings}
    tagged = F.flatten(F.array(*[F.transform(c, _tag(name)) for name, c in channels.items()]))
    return blocks.select("func", "bb_id", F.explode(tagged).alias("t")).select("func", "bb_id", "t.channel", "t.token").distinct()


def _tag(channel: str):
    return lambda t: F.struct(F.lit(channel).alias("channel"), t.alias("token"))


def count_label(n: Column) -> Column:
    out = F.when(n == 0, "0").when(n == 1, "1")
    for top, name in ((3, "2-3"), (7, "4-7"), (15, "8-15"), (31, "16-31"), (63, "32-63")):
        out = out.when(n <= top, name)
    return out.otherwise("64+")


def fingerprints(lines: DataFrame) -> DataFrame:
    """Per function: raw counts of branches, loops and returns over all its lines, and their labels."""
    line = ascii_only(F.coalesce("line", F.lit("")))

    def counted(words: str) -> Column:
        return F.sum(F.regexp_count(line, F.lit(rf"\b({words})\b"))).cast("long")

    d = lines.groupBy("func").agg(counted("if|switch").alias("n_branches"), counted("for|while").alias("n_loops"), counted("return").alias("n_returns"))
    return d.select("func", "n_branches", "n_loops", "n_returns", *[count_label(F.col(f"n_{k}")).alias(k) for k in ("branches", "loops", "returns")])


def block_records(blocks: DataFrame) -> DataFrame:
    """Per block: its lines joined in order, and their number."""
    ordered = F.array_sort(F.collect_list(F.struct("line_index", F.coalesce("line", F.lit("")).alias("line"))))
    return blocks.groupBy("func", "bb_id").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("pseudo"))


def function_texts(records: DataFrame) -> DataFrame:
    """Per function: its non-empty block texts, joined by line breaks."""
    ordered = F.array_sort(F.collect_list(F.struct("bb_id", "pseudo")))
    return records.groupBy("func").agg(F.array_join(F.filter(F.transform(ordered, lambda s: s["pseudo"]), lambda p: p != ""), "\n").alias("text"))


def constants(text: Column) -> Column:
    """Distinct constants as decimal strings, common magnitudes dropped; values just below 2^32 and 2^64 count as negative.

    Hexadecimal numbers of over 16 digits stay as lower-cased strings.
    """
    def value(tok: Column) -> Column:
        digits = F.ltrim(F.substring(F.lower(tok), 3, 1 << 20), F.lit("0"))
        is_hex = F.lower(tok).startswith("0x")
        number = F.when(is_hex & (F.length(digits) <= 16), F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10)).when(~is_hex, tok)
        n = number.try_cast("decimal(38,0)")
        for bits in (64, 32):
            top = F.lit(str(1 << bits)).cast("decimal(38,0)")
            low = F.lit(str((1 << bits) - WRAP)).cast("decimal(38,0)")
            n = F.when((n >= low) & (n < top), (n - top).cast("decimal(38,0)")).otherwise(n)
        common = F.abs(n).isin(*COMMON)
        return F.when(n.isNull(), F.lower(tok)).when(~common, n.cast("string"))

    found = F.regexp_extract_all(ascii_only(text), F.lit(NUMBER), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, value), lambda v: v.isNotNull()))


def calls(text: Column, own: Column) -> Column:
    """Distinct names that are called: no keywords, generated names, or the function's own."""
    found = F.regexp_extract_all(ascii_only(text), F.lit(CALL), F.lit(1))
    return F.array_distinct(F.filter(found, lambda n: ~n.isin(*CALL_WORDS) & ~n.rlike(r"^(sub_|loc_|nullsub|j_)") & (n != own)))


def address_number(a: Column) -> Column:
    """0x... as hexadecimal, else decimal, else bare hexadecimal, else null; white space around is ignored."""
    s = F.lower(F.trim(a))
    digits = F.when(s.rlike(r"^0x[0-9a-f]{1,15}$"), F.substring(s, 3, 20)).when(s.rlike(r"^[0-9]{1,18}$"), F.lit(None)).when(s.rlike(r"^[0-9a-f]{1,15}$"), s)
    return F.coalesce(F.conv(digits, 16, 10).try_cast("long"), F.when(s.rlike(r"^[0-9]{1,18}$"), s.try_cast("long")))


def address_key(a: Column) -> Column:
    return F.coalesce(address_number(a).cast("string"), F.trim(a))


def address_hex(a: Column) -> Column:
    n = address_number(a)
    return F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex(n))), F.trim(a))


def family(name: Column) -> Column:
    """The name without its four configuration segments, if it has them."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    parts = F.split(base, "-", 5)
    return F.when(F.size(parts) == 5, F.get(parts, 4)).otherwise(base)


def is_mirrored(name: Column) -> Column:
    """Whether the name has not the five-segment shape of regular pool entries."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return (base != "") & ~base.rlike(r"^[^-]+-[^-]+-[^-]+-[^-]+-.+$")


def case_name(name: Column) -> Column:
    """A mirrored name without its ten hexadecimal digits; null for others."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.when(is_mirrored(name), F.nullif(F.regexp_extract(base, r"^(.+)-[0-9a-fA-F]{10}$", 1), F.lit("")))


def parse_label(text: Column) -> Column:
    """0, 1, 2 or null: a label within 40 characters after the last 'ANSWER:', else its first letter, else the last label anywhere."""
    up = F.upper(text)
    at = F.length(up) - F.instr(F.reverse(up), F.lit(":REWSNA")) - 6  # characters before the last 'ANSWER:'
    has = F.instr(up, F.lit("ANSWER:")) > 0
    tail = F.substring(up, at + 8, F.lit(40))
    named = F.when(F.contains(tail, F.lit(LABELS[0])), 0).when(F.contains(tail, F.lit(LABELS[1])), 1).when(F.contains(tail, F.lit(LABELS[2])), 2)
    first = F.regexp_extract(tail, r"^\s*(\S)", 1)
    letter = F.when(first == "N", 0).when(first == "H", 1).when(first == "I", 2)

    def last(label: str) -> Column:  # place of the label's last occurrence, 0 if none
        i = F.instr(F.reverse(up), F.lit(label[::-1]))
        return F.when(i > 0, F.length(up) - i - len(label) + 2).otherwise(0)

    p = [last(x) for x in LABELS]
    anywhere = F.when(F.greatest(*p) == 0, F.lit(None)).when((p[0] >= p[1]) & (p[0] >= p[2]), 0).when(p[1] >= p[2], 1).otherwise(2)
    return F.when(has, F.coalesce(named, letter, anywhere)).otherwise(anywhere)
