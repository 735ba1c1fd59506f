"""Each operator against its plain version, and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tests.oracle import compare
from unitloom.llm import common, decontamination, fingerprints, fm_index, language_id, line_dedup, ngram_join, packing, queries, secret_scan, suffix_dedup, token_pieces, token_records, two_stage_sort, url_filters
from unitloom.llm.components import components

SF = "/root/testdata/sf0.001"


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("sizes", [(8, 512), (2, 4)])
def test_ngram_join(spark, docs, rows, monkeypatch, sizes):
    monkeypatch.setattr(ngram_join, "LIST", sizes[0])
    monkeypatch.setattr(ngram_join, "BLOCK", sizes[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == plain.components(pairs(rows))


def test_prefixes_lengthen_with_cost():
    rare, common = np.array([2] * 30, np.uint32), np.array([400] * 100, np.uint32)
    assert ngram_join.choose(100, rare)[0] == 1
    assert ngram_join.choose(100, common)[0] > 1


def test_components(spark):
    e = [(1, 2), (2, 3), (5, 4), (9, 9), (3, 7), (7, 1), *[(100, i) for i in range(101, 160)]]
    got = {r.node: r.component for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 4, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_of_held_out_documents(spark):
    d = queries.documents(spark, "/root/testdata/sf0.01")
    p = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.97 and p.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in p.doc_id)


def test_language_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    d = language_id.new_network(["a", "b"], rng).left
    for name in ("inputs", "weights", "bias"):
        setattr(d, name, getattr(d, name).astype(np.float64))
    x = rng.integers(0, 4, (6, 3))
    g = rng.normal(size=(6, language_id.UNITS, 3)).astype(np.float32)
    kept, states = language_id._run(d, x)
    grads = language_id._back(d, x, kept, g)
    for p, got in zip((d.inputs, d.weights, d.bias), grads, strict=True):
        for at in [(0, 0), (9, 0), (17, 0)]:
            old = p[at]
            p[at] = old + 1e-3
            up = (language_id._run(d, x)[1] * g).sum()
            p[at] = old - 1e-3
            down = (language_id._run(d, x)[1] * g).sum()
            p[at] = old
            assert abs((up - down) / 2e-3 - got[at]) < 2e-2 * max(1, abs(got[at]))


def test_language_gradients_of_windows_of_several_lengths():
    """All parameters, both directions: against differences of a loss that reads each window alone."""
    rng = np.random.default_rng(1)
    net = language_id.new_network(["a", "b"], rng)
    for part in (net.left, net.right):
        for name in ("inputs", "weights", "bias"):
            setattr(part, name, getattr(part, name).astype(np.float64))
    net.out, net.out_bias = net.out.astype(np.float64), net.out_bias.astype(np.float64)
    x, n, y = rng.integers(0, 4, (6, 4)), np.array([6, 2, 1, 4]), np.array([0, 1, 1, 0])

    def loss():
        total = 0.0
        for w in range(4):
            data = x[: n[w], w : w + 1]
            both = np.concatenate([language_id._run(net.left, data)[1], language_id._run(net.right, data[::-1])[1][::-1]], 1)
            logits = net.out @ both + net.out_bias
            total -= np.log(np.exp(logits) / np.exp(logits).sum(1, keepdims=True))[:, y[w], 0].sum()
        return total / n.sum()

    for p, got in zip(net.parameters(), language_id._gradients(net, x, n, y), strict=True):
        for at in [(0, 0), (p.shape[0] - 1, p.shape[1] - 1), (p.shape[0] // 2, min(2, p.shape[1] - 1))]:
            old = p[at]
            p[at] = old + 1e-3
            up = loss()
            p[at] = old - 1e-3
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-3 - got[at]) < 1e-3


def plain_probabilities(net, text):
    """Byte by byte: gates, states of both directions, label of each position, mean."""
    data, k, total = text.encode(), language_id.UNITS, np.zeros(len(net.languages))
    for s in range(0, len(data), language_id.WINDOW):
        part = data[s : s + language_id.WINDOW]
        states = []
        for d, order in ((net.left, part), (net.right, part[::-1])):
            h, out = np.zeros(k), []
            for b in order:
                a, u = d.inputs[:, b], d.weights @ h + d.bias[:, 0]
                z, r = (np.clip((a[i : i + k] + u[i : i + k]) / 4 + 0.5, 0, 1) for i in (0, k))
                h = z * h + (1 - z) * np.tanh(a[2 * k :] + r * u[2 * k :])
                out.append(h)
            states.append(out)
        for left, right in zip(states[0], states[1][::-1], strict=True):
            e = np.exp(net.out @ np.r_[left, right] + net.out_bias[:, 0])
            total += e / e.sum()
    return total / max(1, len(data))


def test_language_of_a_plain_network():
    net = language_id.new_network(["a", "b", "c"], np.random.default_rng(5))
    texts = ["x", "Où est l'école?", "word " * 200, "", "日本語" * 100, "q" * 128]
    for t, got in zip(texts, language_id.probabilities(net, texts), strict=True):
        assert np.allclose(got, plain_probabilities(net, t), atol=1e-4)


def test_languages_of_short_texts_are_learned(spark):
    rows = [(i, "un deux trois", "fr") for i in range(60)] + [(100 + i, "the quick brown fox jumps over the lazy dog and away from the old house", "en") for i in range(60)]
    rows += [(300, "½", "fr"), (301, "²", "fr"), (302, "1 2", "en"), (303, "", "zz"), (304, "ª", "fr")]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[i] for i in range(60)} == {"fr"} and {got[100 + i] for i in range(60)} == {"en"}
    assert got[300] == got[301] == got[302] == got[303] == "und" and got[304] in ("en", "fr")


def test_language_edges(spark, docs, empty):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert got[-1] == ("und", 0.0) and got[-2] == ("und", 0.0) and got[-3] == ("und", 0.0) and got[-4][0] in ("en", "fr")
    assert language_id.identify(empty).count() == 0


@pytest.mark.parametrize("near", [6, 1])
def test_line_dedup(docs, rows, monkeypatch, near):
    monkeypatch.setattr(line_dedup, "NEAREST", near)
    want = plain.removed(pairs(rows))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for d, t in pairs(rows):
        assert set(got[d].gone) == want[d], d
        assert got[d].kept == (t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]))


def test_lines_that_collide_in_32_bits_are_not_equal(spark):
    pairs_ = [("red blue green w197943 end", "red blue green w238015 end"), ("red blue green w103925 end", "red blue green w213573 end")]
    d = spark.createDataFrame([(2 * i + j, t, "en", "s", 26) for i, p in enumerate(pairs_) for j, t in enumerate(p)] + [(9, pairs_[0][0], "en", "s", 26)], plain.SCHEMA)
    assert {r.doc_id: r.n_removed for r in line_dedup.report(d).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 1}


def test_equal_short_lines_and_white_space(spark):
    texts = ["Title\none two three", "title \n\none\tTWO  three\x0b\n \t", "\x0cTITLE\r\nother", None, "", "ha ha ha ha ha\nha ha ha ha ha ha ha"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: list(r.gone) for r in line_dedup.dedup_lines(d).collect()} == {0: [], 1: [0, 2], 2: [0], 3: [], 4: [], 5: [1]}


def test_different_lines_of_five_words_all_stay(spark):
    d = spark.range(4_000).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("alpha beta gamma delta w"), F.col("id") * 100 + i)), "\n").alias("text"))
    assert line_dedup.report(d).agg(F.sum("n_removed")).first()[0] == 0


@pytest.mark.parametrize("n", [40, 400])
def test_line_dedup_of_long_lists(spark, n):
    """Lines around shared passages, so that lists are longer than what is first looked at."""
    r = np.random.default_rng(n)
    base = [[f"b{k}x{i}" for i in range(40)] for k in range(3)]
    rows = []
    for i in range(n):
        w = list(base[i % 3]) if i % 4 else base[i % 3][:14] + [f"own{i}x{j}" for j in range(r.integers(5, 30))]
        for _ in range(r.integers(0, 3)):
            w[r.integers(0, len(w))] = f"e{r.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    want = plain.removed(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: set(x.gone) for x in line_dedup.dedup_lines(d).collect()} == {i: want[i] for i, _ in rows}


def test_runs_written_out_are_the_runs_of_the_line(spark, monkeypatch):
    """On both sides of each block's end, and beyond what is written out."""
    monkeypatch.setattr(line_dedup, "UNROLLED", 8)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    lines = [[100 * n + i for i in range(n)] for n in range(1, 19)]
    d = spark.createDataFrame([(h, [h[i : i + 5] for i in range(max(1, len(h) - 4))]) for h in lines], "h array<long>, runs array<array<long>>")
    got = d.select(line_dedup._tokens("h").alias("got"), F.transform("runs", lambda r: F.xxhash64(*[F.get(r, F.lit(k)) for k in range(5)])).alias("want")).collect()
    assert len(got) == 18 and all(r.got == r.want for r in got)


def plain_phrases(text):
    seen, phrase = set(), b""
    for i in range(len(data := text.encode())):
        phrase += data[i : i + 1]
        if phrase not in seen:
            seen.add(phrase)
            phrase = b""
    return seen


def test_fingerprints_against_plain_phrases(docs, rows):
    """As many phrases as a plain parser finds; signatures from one phrase at a time; likeness near the share of common phrases."""
    order = sorted(pairs(rows))
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    off = []
    for i, (d, t) in enumerate(order):
        mine, other = plain_phrases(t or ""), plain_phrases(order[(i + 1) % len(order)][1] or "")
        least = [0xFFFF] * fingerprints.ENTRIES
        if mine:
            numbers = []
            for p in mine:
                h = 0
                for b in p:
                    h = (h * 1_000_003 + b + 1) % (1 << 58)
                numbers.append(h ^ (h >> 29))
            assert len(set(numbers)) == len(mine)
            least = [min((h * int(a) + int(b)) % (1 << 64) for h in numbers) >> 16 & 0xFFFF for a, b in zip(fingerprints._A, fingerprints._B, strict=True)]
        assert got[d].fingerprint == b"".join(x.to_bytes(2, "little") for x in least).hex()
        if mine and other:
            off.append(abs(got[d].near_next - len(mine & other) / len(mine | other)))
    assert np.mean(off) < 0.06 and max(off) < 0.3


def test_fingerprints(docs, rows):
    order = sorted(pairs(rows))
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t)
        e = t[: n - n // 2] + nxt[: n // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fingerprint(t), fingerprints.fingerprint(e))
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == fingerprints.likeness(r.fingerprint, fingerprints.fingerprint(nxt))


def test_secrets(docs, rows):
    got = {r.doc_id: r for r in secret_scan.secret_report(docs).collect()}
    for d, t in pairs(rows):
        want = plain.secrets(t)
        assert got[d].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (d, want, got[d].spans)
        assert set(filter(None, want.split(","))) <= set(got[d].spans.split(","))


def test_secret_borders(spark):
    texts = ["password=token:abcdefghijklmnop", "API_KEY : 'a.b-c/d+e=f_g1'", "secret=short token=abcdefghijkl", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "0123456789abcde", "0123456789abcdef" * 2, "é\U0001f600token=abcdefghijklé", "pAsSwD\"=\"abcdefghijkl"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.secret_report(d).collect():
        assert r.base_sha256 == hashlib.sha256(plain.secrets(texts[r.doc_id]).encode()).hexdigest(), texts[r.doc_id]


@pytest.mark.parametrize("pattern,text", [("gh[pous]_[a-z]+", "ghp_x"), ("(abc|abd)e?f", "abdf"), ("x{2,3}yz", "xxyz"), ("a.c", "abc"), ("(foo)*barr", "barr")])
def test_trigram_query_holds_for_matches(pattern, text):
    assert re.search(pattern, text)
    assert any(all(g in text.lower() for g in part) for part in secret_scan.trigram_query(pattern))


def test_fm_index():
    rng = np.random.default_rng(3)
    for _ in range(60):
        text = rng.integers(0, 5, rng.integers(1, 80)) * (rng.random() > 0.1)
        index = fm_index.FMIndex(text.astype(np.int64))
        for k in (1, 2, 4):
            p = rng.integers(1, 6, (10, k))
            low, high = index.search(p)
            for q, a, b in zip(p, low, high, strict=True):
                want = [i for i in range(len(text) - k + 1) if (text[i : i + k] == q).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("shard", [1_000_000, 50])
def test_decontamination(spark, docs, rows, monkeypatch, shard):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    items = [(7, rows[0][1]), (8, " ".join(rows[1][1].split()[10:24])), (70, "One two"), (9, "one TWO"), (10, ""), (11, None), (12, "abc abc abc"), (13, "école où")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontamination.report(docs, b).collect()}
    assert got == plain.leaks(pairs(rows), items)


def test_decontamination_in_parts_and_without_items(spark, docs, rows, monkeypatch):
    items = [(i, " ".join(rows[1][1].split()[i : i + 12])) for i in range(0, 60, 12)]
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "PART_CHARS", 100)
    got = {r[0]: tuple(r)[1:] for r in decontamination.report(docs, b).collect()}
    assert got == plain.leaks(pairs(rows), items)
    assert decontamination.report(docs, b.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_parts_reports_each_row(spark, monkeypatch):
    items = [(i, f"a{i} b{i} c{i} d{i}") for i in range(30)]
    b = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, items[3][1]), (1, items[3][1]), (1, f"x {items[20][1]} {items[5][1]}"), (None, items[7][1]), (None, items[8][1] + " y"), (None, None), (2, ""), (2, None), (3, "clean words")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(map(tuple, decontamination.report(d, b).collect()), key=repr)
    monkeypatch.setattr(decontamination, "PART_CHARS", 100)
    assert len(want) == len(texts)
    assert sorted(map(tuple, decontamination.report(d, b).collect()), key=repr) == want


def test_without_spans():
    assert decontamination.without_spans("A, bc-d e!", [(1, 3)]) == "A,  e!"


def ids_of(name, text, end):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(queries.tokenizer(name)).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing(docs, rows):
    p = packing.pack(docs, queries.tokenizer("word_bpe_49k.json")).toPandas()
    want = {d: ids_of("word_bpe_49k.json", t, 1) for d, t in pairs(rows)}
    for r in p.itertuples():
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
    assert sum(p.groupby("sequence_id").length.sum()) >= 0.9 * 2048 * (p.sequence_id.nunique() - 1)
    assert p.groupby("doc_id").length.sum().to_dict() == {d: len(x) for d, x in want.items()}
    for _, s in p.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 2048 and s.length.sum() == s.pattern_length.iloc[0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_is_the_tokenizers(name):
    """Random strings of characters on which chunks and pieces could part."""
    from tokenizers import Tokenizer

    tok, e, r = Tokenizer.from_file(queries.tokenizer(name)), token_pieces.Encoder(queries.tokenizer(name)), np.random.default_rng(7)
    prose = ["the", "Word", "été", "Été", "naïve", "ÀÖ", ",", ".", ", ", ". ", " ", "\n", "a"]
    odd = [*prose, "  ", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\u00a0", "\u2028", "\u3000", "\u200b", "e\u0301", "İ", "ß", "Σ", "日本", "\U0001f600", "'s", "n't", "42", "<|", "|>", "<unk>", "_", "-", "\"", "Ġ", "\x00"]
    for i in range(6_000):
        text = "".join(r.choice(prose if i % 2 else odd, r.integers(0, 14)))
        assert np.frombuffer(e.packed(text), e.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_latin_letters_are_encoded_alone(name):
    """Without the tokenizer around the model, and as it would; likewise with marks behind them."""
    e, n = token_pieces.Encoder(queries.tokenizer(name)), []
    texts = [f"{w}{m}" for w in ["étées", "naïvößÿ", *map(chr, range(0xDF, 0x100)), "mañana"] for m in ("", "#", "$$$", "ª", "'s", "1")]
    want = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(e.packed(x), e.dtype).tolist() for x in texts] == want
    e.whole = lambda x: n.append(x) or b""
    for x in ("çéleçaux", "ñandú"):
        assert np.frombuffer(e.packed(x), e.dtype).tolist() == e.tok.encode(x, add_special_tokens=False).ids
    assert n == []


def test_packing_holds_few_texts_at_once(spark, monkeypatch):
    def sizes(docs, *_):
        def count(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (0, 0, b.num_rows, 0, 0)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        return docs.mapInArrow(count, packing.PIECES)

    before = {k: spark.conf.get(k) for k in common.SMALL_BATCHES}
    monkeypatch.setattr(packing, "pieces", sizes)
    lengths = [r.length for r in packing.pack(spark.range(0, 2000, 1, 1), "").collect()]
    assert sum(lengths) == 2000 and max(lengths) <= 500
    assert {k: spark.conf.get(k) for k in common.SMALL_BATCHES} == before


def test_padding_of_a_table(spark):
    p = queries.op7_packing(spark, SF).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("pattern_length").alias("pattern")).toPandas()
    padded = [2048 if n & (n - 1) else 0 for n in p.n]
    assert (p.n == p.pattern).all() and sum(max(0, w - n) for w, n in zip(padded, p.n, strict=True)) <= 0.02 * p.n.sum() + 2048


def test_patterns_place_every_length():
    h = {2048: 3, 1500: 10, 700: 9, 548: 4, 90: 100, 1: 5}
    got = {}
    for count, pattern in packing.shortest_pack_first(h):
        assert sum(pattern) <= 2048
        for x in pattern:
            got[x] = got.get(x, 0) + count
    assert got == h


def test_token_records(docs, rows, tmp_path):
    out = f"file://{tmp_path}/r"
    got = {r.doc_id: r for r in token_records.token_records(docs, queries.tokenizer("byte_bpe_50k.json"), 0, out).collect()}
    start, want = 0, {}
    for d, t in sorted(pairs(rows)):
        x = want[d] = ids_of("byte_bpe_50k.json", t, 0)
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(x), zlib.crc32(x))
        start += len(x)
    first = sorted(p.name for p in (tmp_path / "r").glob("*.rec"))[0]
    for doc, ids in token_records.read_at(out, first[:-4], [2, 0, 1]):
        assert (ids == want[doc]).all()
    data = bytearray((tmp_path / "r" / first).read_bytes())
    data[14] ^= 1
    (tmp_path / "r" / first).write_bytes(data)
    with pytest.raises(ValueError):
        token_records.read_at(out, first[:-4], [0])


def rule_of(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = plain.lower(host)
    fits = [(len(h + p), v, h + p) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_url_filters(spark, limit):
    urls = [None, "", "foo", "http://NET/", "http://a.net", "x://b.Example.COM/de/q?x", "http://org/fr/#", "http://example.net/en/", "http://example.net/EN/x", "http://..net/", "a\nb://q.org/fr/\nx", "http://xnet/", "http://example.net/en/", "http://a.example.com/de"]
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in url_filters.filter_urls(p, rules, limit=limit).collect()}
    assert got == {i: rule_of(u) for i, u in enumerate(urls)}
    assert url_filters.filter_urls(p, rules.limit(0), limit=limit).where("rule is not null").count() == 0
    assert url_filters.filter_urls(p.limit(0), rules, limit=limit).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_url_filters_keep_repeated_rows_and_nulls(spark, limit):
    """A row for each input row; columns named like those that the operator adds are no hindrance."""
    names = ["verdict", "host", "path", "rule", "key", "h0", "level", "size", "row", "mine"]
    rows = [(1, "http://a.net/x"), (1, "http://a.net/x"), (2, None), (None, "http://www.example.net/en/"), (None, None), (3, "http://" + "sub." * 5_000 + "org/fr/" + "x" * 50_000)]
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    p = spark.createDataFrame([(*r, *[7] * len(names)) for r in rows], "page_id long, url string" + "".join(f", `{n}` int" for n in names))
    got = [(r.page_id, r.rule, r.verdict) for r in url_filters.filter_urls(p, rules, limit=limit).select("page_id", "rule", "verdict").collect()]
    assert sorted(got, key=repr) == sorted([(i, rule_of(u)[2], rule_of(u)[3]) for i, u in rows], key=repr)


def test_cascade_is_exact_over_many_keys(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"), (F.col("id") % 7 == 0).alias("mine"))
    mine, others = keys.where("mine").drop("mine"), keys.where("not mine").drop("mine")
    levels = url_filters.build_cascade(mine, others)
    assert len(levels) > 1
    for d, want in ((mine, True), (others, False)):
        h = d.select(*[url_filters.key_hash(i).alias(f"h{i}") for i in range(len(levels))]).toPandas()
        assert (url_filters.member(levels, [h[c].to_numpy() for c in h]) == want).all()


def test_suffix_dedup(docs, rows):
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.report(docs).collect()}
    assert got == plain.repeats(pairs(rows))


def test_suffix_dedup_over_chunks(spark, docs, rows, monkeypatch):
    """Texts longer than what is worked on at once."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.report(docs).collect()} == plain.repeats(pairs(rows))


def test_ngram_join_over_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 300)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()} == plain.components(pairs(rows))


def test_two_stage_sort():
    rng = np.random.default_rng(0)
    for _ in range(150):
        m = rng.integers(1, 7)
        rows = rng.integers(0, rng.integers(1, 4), (m, 25)).astype(np.uint8)
        t, _ = two_stage_sort.joined(rows, rng.integers(0, 26, m))

        def key(i, t=t):
            out = []
            while t[i] > 0:
                out.append((int(t[i]), 0))
                i += 1
            return [*out, (0, i)]

        want = sorted(range(len(t)), key=key)
        assert two_stage_sort.suffix_array(t).tolist() == want
        lcp = two_stage_sort.neighbours_prefix(t, np.array(want), 9)
        for k in range(1, len(want)):
            a, b = key(want[k - 1])[:-1], key(want[k])[:-1]
            n = 0
            while n < min(len(a), len(b), 9) and a[n] == b[n]:
                n += 1
            assert lcp[k] == n


OPERATORS = {
    "op1": lambda d: ngram_join.near_duplicates(d), "op2": lambda d: language_id.identify(d), "op3": lambda d: line_dedup.report(d), "op4": lambda d: fingerprints.fingerprints(d), "op5": lambda d: secret_scan.secret_report(d),
    "op6": lambda d: decontamination.report(d, d.sparkSession.createDataFrame([(1, "two three")], "item_id long, text string")), "op7": lambda d: packing.pack(d, queries.tokenizer("word_bpe_49k.json")),
    "op9": lambda d: token_records.token_records(d, queries.tokenizer("byte_bpe_50k.json")), "op10": lambda d: suffix_dedup.report(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_repeated_rows_and_nulls(clashing, name):
    rows = OPERATORS[name](clashing).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == [1, 1, 2, None]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


def test_stored_writes_no_checksum_files(spark, tmp_path, monkeypatch):
    """The usual local file system writes a checksum file beside each, which starts a process of its own."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    t = common.stored(spark.range(10).repartition(3), "ten")
    assert list(tmp_path.rglob("*.parquet")) and not list(tmp_path.rglob("*.crc")) and t.count() == 10
    assert spark.conf.get("fs.file.impl", None) is None
