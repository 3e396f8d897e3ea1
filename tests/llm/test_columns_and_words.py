"""Words made to collide, callers' columns of any name, rows without an id, the whole pipeline."""
from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetaudit.llm import mixing, neardup, recompress
from fleetaudit.llm.text import numbered_words, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Every name that an operator of a stage gives to a column of its own.
NAMES = ["id", "row", "row_number", "word", "bit", "mask", "doc", "froms", "tos", "spans", "own", "others", "key", "value", "group", "first", "size", "place", "slice", "tie", "of",
         "start", "turn", "turns", "taken", "position", "every", "part", "number", "score", "lang_pred", "component", "component_id", "kept", "file", "at", "new"]


def thue_morse(letters: int, a: str, b: str) -> str:
    return "".join(b if i.bit_count() % 2 else a for i in range(letters))


@pytest.fixture(scope="module")
def crafted(spark):
    """Pairs of texts that differ in one long word, which a polynomial of the letters gives one value."""
    rows = []
    for n, letters in enumerate((1024, 2048, 4096)):
        for k, word in enumerate((thue_morse(letters, "a", "b"), thue_morse(letters, "b", "a"))):
            rows.append((10 * n + k, " ".join(f"w{n}x{i}" if i != 12 else word for i in range(25)), "en", "s", 1))
            rows.append((100 + 10 * n + k, word, "en", "s", 1))
    return spark.createDataFrame(rows, SCHEMA)


def test_word_hashes_of_crafted_words():
    import numpy as np
    words = [thue_morse(n, *ab).encode() for n in (1024, 2048, 4096) for ab in ("ab", "ba")] + [b"x", b"x"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    assert len(set(word_hashes(data, starts, ends).tolist())) == 7
    number, kinds = numbered_words(data, starts, ends)
    assert [kinds[int(i)].as_py() for i in number] == words


def test_crafted_words_neither_link_nor_repeat(crafted):
    # One word of 25 differs: 23 of 27 pairs of words in common at most, so 85 percent of shingles would link; the single words would not.
    singles = crafted.where("doc_id >= 100")
    assert all(r.kept for r in neardup.near_duplicates(singles, width=2).collect())
    assert neardup.drop_near_duplicates(crafted).count() == crafted.count()
    got = {r.doc_id: r.n_removed for r in recompress.removal_digests(crafted).collect()}
    assert set(got.values()) == {0}
    assert sorted(r.text for r in recompress.remove_repeats(crafted).collect()) == sorted(r.text for r in crafted.collect())


@pytest.fixture(scope="module")
def clashing(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [None, "", passage, passage, passage + " more", "other words " + passage, "some plain words in a row", "some plain words in a row", "one two three"]
    df = spark.createDataFrame([(None if i == 3 else i, t, "en", ["s", "t", None][i % 3], 1) for i, t in enumerate(texts)], SCHEMA)
    return df.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(n) for n in NAMES]).repartition(3)


@pytest.mark.parametrize("from_files", [False, True])
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_leave_the_callers_columns_alone(spark, clashing, tmp_path, name, from_files):
    docs = clashing
    if from_files:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.columns[:len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows or name == "language_id"
    for r in rows:
        for n in NAMES:
            assert r[n] == f"{n} of {-1 if r.doc_id is None else r.doc_id}"


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (None, "only here x y z"), (None, None), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=2).collect()), key=str)
    assert got == sorted([(None, 5, 5, False), (None, 5, 5, False), (5, 5, 5, True), (None, 4, None, True), (None, 0, None, True), (7, 0, 7, True)], key=str)


def test_mix_of_many_sources_and_rows_without_an_id(spark):
    """More sources than ranges; targets as resharing by hand gives them; null ids in slices of their own."""
    rows = [(None if i % 3 else i, "w " * (1 + i % 17), None, f"s{i % 150:03d}" if i % 7 else None, 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    sizes: dict = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
        free -= over
    want.update({s: level * weight[s] for s in free})
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source] and r.taken <= 2 * r.size
    for s in order:
        assert sum(r.taken for r in got if r.source == s) == round(want[s])
    assert len(mixing.sized(docs.where("doc_id is null")).select("slice").distinct().collect()) > 10
    assert sorted(tuple(r) for r in mixing.training_order(docs).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect() if r[0]) == \
        sorted((s, round(want[s])) for s in order if s)


def test_stage_tables_go_when_nothing_reads_them(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a", passage), (2, "a", passage + " more")], "doc_id long, source string, text string")
    stages, at = dict(corpus_pipeline.STAGES), str(tmp_path)
    cut = stages["substring_dedup"](spark, docs, at)
    (_, folder), = next(v for k, v in corpus_pipeline._left.items() if k[2] == at)
    stages["mix_sources"](spark, cut, at)  # still reads them
    assert os.path.isdir(folder)
    cut.write.parquet(f"{at}/cut")
    assert stages["bpe"](spark, spark.read.parquet(f"{at}/cut"), at).count() == 2
    assert not os.path.exists(folder)
