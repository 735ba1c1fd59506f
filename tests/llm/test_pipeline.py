"""The pipeline against plain versions of its stages."""

import pytest

import corpus_pipeline as c
from tests.llm import plain
from tests.llm.conftest import EDGES, made


def test_stages(spark, tmp_path):
    rows = made(48, 5) + EDGES
    items = [(1, " ".join(rows[0][1].split()[:12]))]
    spark.createDataFrame(rows, plain.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = c.documents(spark, str(tmp_path))
    held = [(n, c.stored(f(spark, d, str(tmp_path)), n)) if n == "language_id" else (n, f) for n, f in c.STAGES]
    d = held[0][1]
    kept = {r.doc_id: r.text for r in d.collect()}
    assert kept == {i: t for i, t, *_ in rows if t and any(x.isalpha() for x in t)}

    gone = plain.removed(list(kept.items()))
    want = {}
    for i, t in kept.items():
        left = [x for k, x in enumerate(t.split("\n")) if k not in gone[i]]
        if not gone[i] or any(map(plain.line_tokens, left)):
            want[i] = "\n".join(left)
    d = c.stored(c.lines(spark, d, str(tmp_path)), "lines")
    assert {r.doc_id: r.text for r in d.collect()} == want

    comp = plain.components(list(want.items()))
    want = {i: t for i, t in want.items() if comp[i][1] == i}
    d = c.stored(c.near_duplicates(spark, d, str(tmp_path)), "near")
    assert {r.doc_id: r.text for r in d.collect()} == want

    leak = plain.leaks(list(want.items()), items)
    want = {i for i in want if not leak[i][4]}
    d = c.stored(c.decontaminate(spark, d, str(tmp_path)), "clean")
    assert {r.doc_id for r in d.collect()} == want and list(d.columns) == list(c.COLUMNS)
    assert {r.doc_id for r in c.pack(spark, d, str(tmp_path)).collect()} == want
    assert {r.doc_id for r in c.run(spark, str(tmp_path)).collect()} == want


def test_documents_without_a_word_left_go(spark):
    licence = "this text is free for all to use"
    texts = [licence + "\nTitle", licence + "\nroses are red\nviolets\tare blue", licence + "\ntitle ", licence + "\n \n", licence + "\nvioletsareblue\nviolets are  BLUE", "TITLE", licence, "1\n\n"]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], plain.SCHEMA)
    got = {r.doc_id: r.text for r in c.lines(spark, d, "").collect()}
    assert got == {0: texts[0], 1: "roses are red\nviolets\tare blue", 4: "violetsareblue", 7: texts[7]}


STAGE = dict(c.STAGES)


@pytest.mark.parametrize("name", [n for n, _ in c.STAGES])
def test_stage_on_empty_repeated_and_clashing_rows(spark, tmp_path, empty, clashing, name):
    spark.createDataFrame([(1, "two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert STAGE[name](spark, empty, str(tmp_path)).count() == 0
    out = STAGE[name](spark, clashing, str(tmp_path))
    ids = sorted((r.doc_id for r in out.collect()), key=repr)
    assert ids == {"language_id": [1, 1, None], "line_dedup": [1, 1, 2, None], "ngram_join": [1, 2, None], "decontamination": [2, None], "packing": [1, 1, 2, None]}[name]
    if name != "packing":
        assert out.columns == list(c.COLUMNS)
