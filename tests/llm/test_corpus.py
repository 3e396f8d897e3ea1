"""Each corpus operator against brute force on small documents: nulls, empty and long texts, ties, repeats, no rows."""
from __future__ import annotations

import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetaudit.llm import bpe, bwt, fingerprint, langid, mixing, mtree, neardup, quality, recompress, toxicity
from fleetaudit.llm.components import components
from fleetaudit.llm.text import Substrings, map_blocks
from fleetaudit.llm.queries import QUERIES, tokenizer_path
from fleetaudit.session import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgé"), rng.integers(2, 7))) for _ in range(n))


PASSAGE = words(1, 70)
TEXTS = [
    None, "", " \t\n", "one", "One two", "one TWO", words(2, 120), words(2, 120), words(2, 120) + " end", PASSAGE,
    words(3, 40) + " " + PASSAGE + "\n" + words(4, 30), words(5, 15) + " " + PASSAGE, "again " * 60, "ab " * 30 + "x " + "ab " * 45,
    words(6, 4000), words(6, 3990) + " tail", "<|endoftext|> it's 12 ½ 日本 🎉🎉" + " " * 40, "a" * 3001, words(7, 30) + "\n" + words(8, 90), words(8, 90) + "\n" + words(7, 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s1", None][i % 4], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    # Extra columns with the names that operators add.
    return spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("x")).withColumn("score", F.lit(1)).withColumn("start", F.lit(2)).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sha(b) -> str:
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_fingerprints(docs, nothing):
    texts = [t or "" for t in TEXTS]
    got = {r["doc_id"]: r for r in fingerprint.edits(docs, parts=5).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        edited = t[:len(t) - len(t) // 2] + texts[i - 1][:len(t) // 2]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), sha(edited))
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[6]["fingerprint"] == got[7]["fingerprint"] != got[8]["fingerprint"]
    assert got[18]["fingerprint"] == got[19]["fingerprint"]  # the same paragraphs in another order
    assert fingerprint.edits(nothing).count() == 0


def test_fingerprint_insert_delete():
    units = fingerprint.paragraphs(TEXTS[18])
    whole = fingerprint.state(TEXTS[18])
    assert (fingerprint.insert(fingerprint.vectors(units[:1]), units[1:]) == whole).all()
    assert (fingerprint.delete(whole, units[1:]) == fingerprint.vectors(units[:1])).all()
    a, b = [words(s, 9) for s in range(60)], [words(s, 9) for s in range(30, 90)]
    assert abs(fingerprint.likeness(fingerprint.vectors(a), fingerprint.vectors(b)) - 0.5) < 0.15


def test_bpe(docs, nothing):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: r for r in bpe.token_digests(docs, tokenizer_path()).collect()}
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False)))
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want, i
    back = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert bpe.token_digests(nothing, tokenizer_path()).count() == 0


def brute_near(texts, width):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    part = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    return [(i, len(s), part[i], part[i] == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, nothing, width):
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs, width).collect()) == brute_near(TEXTS, width)
    assert neardup.near_duplicates(nothing, width).count() == 0


def test_near_duplicates_long_lists(spark):
    """One group of near copies of a text, some linked only through others, across several blocks."""
    rng = np.random.default_rng(5)
    base = words(9, 60).split()
    texts = []
    for i in range(120):
        w = list(base)
        for p in rng.integers(0, 60, i % 9):
            w[p] = f"z{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before, neardup.BLOCK_MEMBERS = neardup.BLOCK_MEMBERS, 16
    try:
        assert sorted(tuple(r) for r in neardup.near_duplicates(df, 2).collect()) == brute_near(texts, 2)
    finally:
        neardup.BLOCK_MEMBERS = before


def brute_bytes(texts, window):
    raw, seen = [(t or "").encode() for t in texts], {}
    for b in raw:
        for p in range(len(b) - window + 1):
            seen[b[p:p + window]] = seen.get(b[p:p + window], 0) + 1
    out = []
    for i, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if seen[b[p:p + window]] > 1:
                gone[p:p + window] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0, sha(kept)))
    return out


def test_bwt(docs, nothing):
    assert sorted(tuple(r) for r in bwt.removal_digests(docs).collect()) == brute_bytes(TEXTS, 200)
    assert bwt.removal_digests(nothing).count() == 0


def test_bwt_crowded_anchors_agree(spark, docs):
    texts = bwt.documents(docs, "doc_id", "text")
    def starts(crowded):
        return {(r["doc"], p) for r in bwt.repeated_spans(texts, crowded=crowded).collect() for p in range(r["a"], r["b"])}
    assert starts(1) == starts(1000)


def test_merge_of_transforms():
    rng = np.random.default_rng(3)
    shard = [[bytes(rng.integers(97, 100, rng.integers(1, 60)).astype(np.uint8)) for _ in range(6)] for _ in range(4)]
    seen = {}
    for s in (s for b in shard for s in b):
        for p in range(len(s) - 7):
            seen[s[p:p + 8]] = seen.get(s[p:p + 8], 0) + 1
    got = bwt.repeated_starts(shard, 8)
    assert [[list(x) for x in b] for b in got] == [[[p for p in range(len(s) - 7) if seen[s[p:p + 8]] > 1] for s in b] for b in shard]


def test_parts_that_may_repeat_lose_no_window():
    rng = np.random.default_rng(5)
    window, anchor, bodies = 20, b"ANCHOR", []
    for _ in range(200):
        count = int(rng.integers(1, 13))
        place = int(rng.integers(count - 1, 15))
        sides = [bytes(rng.choice([97, 98], k, p=[0.9, 0.1]).astype(np.uint8)) for k in (place, count - 1 + window - place - 6)]
        bodies.append(sides[0] + anchor + sides[1])
    bodies = list(dict.fromkeys(bodies))
    starts = [range(len(b) - window + 1) for b in bodies]
    seen = {}
    for b, at in zip(bodies, starts):
        for p in at:
            seen[b[p:p + window]] = seen.get(b[p:p + window], 0) + 1
    keys = np.repeat(Substrings(np.frombuffer(anchor, np.uint8)).hash(np.array([0]), np.array([6])).view(np.int64), len(bodies))
    again = [[p for p in at if seen[b[p:p + window]] > 1] for b, at in zip(bodies, starts)]
    for pieces in (1, 2, 4, 15):
        low, high = bwt.shared_parts(bodies, keys, window, 6, pieces)
        assert all(low[i] <= p <= high[i] for i, at in enumerate(again) for p in at)
    # Pieces of one place each are whole windows.
    assert any(again) and all((low[i] > high[i]) if not at else (low[i], high[i]) == (at[0], at[-1]) for i, at in enumerate(again))


def brute_words(texts, window):
    split, seen, out = [WORD.findall(t or "") for t in texts], set(), []
    for i, w in enumerate(split):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            if key in seen:
                gone[p:p + window] = [True] * window
            seen.add(key)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def test_recompression(docs, nothing):
    assert sorted(tuple(r) for r in recompress.removal_digests(docs).collect()) == brute_words(TEXTS, 20)
    assert recompress.removal_digests(nothing).count() == 0


def test_symbols_inside_equal_passages_are_equal():
    passage = words(11, 60)
    found = []
    for text in (words(12, 30) + " " + passage + " " + words(13, 9), passage + " " + words(14, 50)):
        raw = text.encode()
        group = recompress.word_groups(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
        found.append(set(group[3].tolist()))
    assert len(found[0] & found[1]) >= 4


def brute_targets(sizes):
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left, w = total - sum(2 * sizes[n] for n in full), sum(weight[n] for n in names if n not in full)
        over = [n for n in names if n not in full and left * weight[n] / w > 2 * sizes[n]]
        if not over:
            return {n: 2.0 * sizes[n] if n in full else left * weight[n] / w for n in names}
        full |= set(over)


def test_mixing(docs, nothing):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS)
    size, taken, target = {}, {}, {}
    for r in got:
        assert r["size"] == len(WORD.findall(TEXTS[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert target == pytest.approx(brute_targets(size))
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in size)
    order = mixing.training_order(docs)
    assert order.columns == docs.columns
    total = sum(len(WORD.findall(r["text"])) for r in order.collect())
    assert total == sum(taken.values())
    assert mixing.mix(nothing).count() == 0 and mixing.training_order(nothing).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(8)
    vectors = [[float(x) for x in rng.normal(0, 0.3, 8)] for _ in range(400)]
    vectors[10:60] = [vectors[10]] * 50
    vectors[100], vectors[150], vectors[200], vectors[250] = None, [1.0, None] + [0.0] * 6, [float("nan")] * 8, []
    vectors[300] = [0.5, 0.25]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    usable = {r["vec_id"]: r["embedding"] for r in df.collect() if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])}
    whole = {i: np.floor(256 * np.array(v, np.float64)).astype(int) for i, v in usable.items()}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    before, mtree.SUBTREE = mtree.SUBTREE, 64
    try:
        assert sorted(tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 50 == 0).collect()) == sorted(want)
        assert mtree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    finally:
        mtree.SUBTREE = before


def test_language(spark, docs, nothing):
    got = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in got)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    model = langid.learn(docs)
    scored = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [scored[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and scored[0]["score"] == 0
    assert all(r["lang_pred"] == "und" for r in langid.predict(docs, langid.learn(nothing)).collect())
    assert langid.predict(nothing, model).count() == 0


def test_toxicity(spark, docs, nothing):
    rng = np.random.default_rng(2)
    common, bad = [words(s, 1) + "ly" for s in range(300)], ["horrible", "dreadful", "nasty"]
    def text(toxic):
        w = list(rng.choice(common, 40))
        return " ".join([*w, str(rng.choice(bad))] if toxic else w)
    made = spark.createDataFrame([(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(600)], "doc_id long, text string, label int")
    how = toxicity.Training(padding=20)
    model = toxicity.train(toxicity.sample(made, made.select("doc_id", "label"), how), how)
    logit, bias = model
    def raw(t):
        b = np.frombuffer(t.encode(), np.uint8)
        return toxicity.score_block(np.array([0, len(b)]), b, logit, bias, 20)[0]
    assert raw(" ".join(common[:20]) + " horribble dreadfull") > raw(" ".join(common[:20]) + " table chairs")
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored)
    assert toxicity.score(nothing, toxicity.train(toxicity.sample(nothing, made.select("doc_id", "label").limit(0)))).count() == 0


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(8)] + [(3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels, F.col("source"), F.col("lang")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(TEXTS)))
    assert all(0 < r["score"] < 1 and 0 < r["path_rate"] < 1 and r["keep"] == (r["score"] >= 0.5) for r in got)
    assert quality.score(nothing, labels, F.col("source"), F.col("lang")).count() == 0
    flat = quality.score(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert all(r["keep"] and r["evidence"] == 0.5 for r in flat)
    whole = QUERIES["op3_quality_bayes"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([r["keep"] == bool(r["quality"]) for r in whole]) > 0.9


def test_pipeline(spark, docs, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mix_sources", "bpe"]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    now = plain
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = corpus_pipeline.staged(stage(spark, now, ""), name)
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        if i < 4:
            assert now.columns == plain.columns
        if name == "near_dedup":
            ids = sorted(before)
            want = brute_near([before[k] for k in ids], 5)
            assert sorted(after) == [k for k, w in zip(ids, want) if w[3]]
        if name == "substring_dedup":
            ids = sorted(before)
            want = brute_words([before[k] for k in ids], 20)
            assert {k: sha(" ".join(WORD.findall(after[k]))) for k in ids} == {k: w[3] for k, w in zip(ids, want)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, words(20, 50)), (1, words(20, 50)), (None, words(20, 50)), (2, None), (2, None)], "doc_id long, text string")
    left = rows(neardup.drop_near_duplicates(df))
    assert left == rows(spark.createDataFrame([(1, words(20, 50)), (2, None), (2, None)], "doc_id long, text string"))


def test_rows_without_an_id_or_with_a_repeated_one_are_documents_of_their_own(spark):
    """Same passage at the same place under null ids; clean texts beside it under the same ids stay whole."""
    texts = [PASSAGE + " " + words(31, 25), PASSAGE + " " + words(32, 25), words(33, 95), words(34, 95), PASSAGE + " " + words(31, 25)]
    ids = [None, None, None, 1, None]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1)
    order = [3, 0, 1, 2, 4]  # nulls last, in the order of reading
    want = brute_words([texts[i] for i in order], 20)
    assert rows(recompress.removal_digests(df)) == sorted(((ids[i], *w[1:]) for i, w in zip(order, want)), key=str)
    left = {t for _, t in rows(recompress.remove_repeats(df))}
    assert texts[0] in left and texts[2] in left and texts[3] in left and words(32, 25) in left and "" in left
    assert rows(bwt.removal_digests(df)) == sorted(((i, *w[1:]) for i, w in zip(ids, brute_bytes(texts, 200))), key=str)
    # Different texts under one id: the passage stays in one of them, whichever, and nothing else is cut.
    again = spark.createDataFrame([(1, t) for t in texts[:3]] + [(1, texts[2])], "doc_id long, text string")
    kept = [t for _, t in rows(recompress.remove_repeats(again))]
    assert kept.count(texts[2]) == 2 and sorted(t for t in kept if t != texts[2]) in (sorted([texts[0], words(32, 25)]), sorted([words(31, 25), texts[1]]))


def test_near_duplicates_go_whatever_the_packing_of_files(spark, tmp_path, monkeypatch):
    """Files are packed into partitions anew between the jobs, as when an executor joins or is lost."""
    clean = [words(s, 30 + s % 7) for s in range(40, 60)]
    texts = clean + [t + " end" for t in clean[::2]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12).write.parquet(str(tmp_path / "docs"))
    size, turn, write = "spark.sql.files.maxPartitionBytes", [0], neardup.staged
    before = spark.conf.get(size)

    def moved(df, name):
        out = write(df, name)
        turn[0] += 1
        spark.conf.set(size, ("1k", "64m")[turn[0] % 2])
        return out

    monkeypatch.setattr(neardup, "staged", moved)
    try:
        spark.conf.set(size, "64m")
        left = rows(neardup.drop_near_duplicates(spark.read.parquet(str(tmp_path / "docs"))))
    finally:
        spark.conf.set(size, before)
    assert left == rows(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string"))


def test_near_copies_always_share_a_run():
    """Sets of any size at the threshold have a value in common, those that only share frequent shingles none."""
    rng = np.random.default_rng(5)

    def values(shingles):
        held = np.sort(shingles)[:neardup.RETAINED]
        return set(neardup.run_values(np.array([0, len(held)]), held, np.array([len(shingles)]))[0].tolist())

    for size in [*range(4, 100), 150, 250, 400]:
        for _ in range(5):
            one = rng.choice(1 << 54, size, replace=False)
            gone = rng.integers(0, size // 5 + 1)
            more = rng.integers(0, (size - gone) * 5 // 4 - size + 1) if (size - gone) * 5 // 4 >= size else 0
            other = np.append(rng.permutation(one)[gone:], rng.choice(1 << 54, more))
            if 100 * (size - gone) >= 80 * (size + more):
                assert values(one) & values(other)
    frequent = rng.choice(1 << 54, 30)
    alone = [values(np.append(frequent, rng.choice(1 << 54, 300))) for _ in range(60)]
    met = sum(bool(a & b) for i, a in enumerate(alone) for b in alone[:i])
    assert met < 0.05 * 60 * 59 / 2  # by single hashes all of them meet


def test_links_of_a_block_connect_and_no_more():
    """Blocks of near copies give fewer links than members, and unsure pairs only between what no sure link connects."""
    rng = np.random.default_rng(6)
    base = np.sort(rng.choice(1 << 54, 100, replace=False))
    sets = [np.sort(np.append(np.delete(base, i), rng.integers(1 << 54))) for i in range(100)]

    def block(sets, n, components):
        size = len(sets)
        bounds = np.append(0, np.cumsum([len(s) for s in sets]))
        return {"id": np.arange(size), "component": np.array(components), "n": np.array(n), "is_main": np.zeros(size, bool),
                "sketch": (bounds, np.concatenate(sets)), "indexed": (np.arange(size + 1), np.full(size, 7))}

    whole = block(sets, [len(s) for s in sets], range(100))
    a, b, sure = neardup.links_between(whole, whole, 7, 80)
    assert sure.all() and (a < b).all() and len(a) == 99
    of = np.arange(100)
    for x, y in zip(a, b):
        of[of == of[x]] = of[y]
    assert len(set(of)) == 1
    large = block(sets, [300] * 100, range(100))  # not held whole: all of them are to be verified
    large["sketch"] = whole["sketch"]
    a, b, sure = neardup.links_between(large, large, 7, 80)
    assert not sure.any()


def test_merge_of_four_symbols_a_round(monkeypatch):
    """The same windows as by plain search, whether four symbols are read by rank or two, and half the rounds for four."""
    rng = np.random.default_rng(12)
    base = bytes(rng.integers(97, 101, 700).tolist())
    strings = [base[i:i + 320] for i in range(0, 380, 45)] + [bytes(rng.integers(97, 123, 260).tolist()) for _ in range(4)] + [b"a" * 230, b"ab" * 120]
    shard, window = [strings[:5], strings[5:9], strings[9:]], 200
    seen: dict = {}
    for s in strings:
        for i in range(len(s) - window + 1):
            seen[s[i:i + window]] = seen.get(s[i:i + window], 0) + 1
    want = [[i for i in range(len(s) - window + 1) if seen[s[i:i + window]] > 1] for s in strings]
    sorts = []
    sort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **kw: sorts.append(x.dtype) or sort(x, **kw))
    for ranks in (1 << 16, 4):
        monkeypatch.setattr(bwt, "RANKS", ranks)
        before = len(sorts)
        assert [at.tolist() for block in bwt.repeated_starts(shard, window) for at in block] == want
        assert (len(sorts) - before < 150) == (ranks > 4)


def test_texts_reach_python_by_bytes(spark):
    """Batches of long texts are bounded by their bytes, whatever the number of rows."""
    def size(batch):
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    df = prepare(spark).range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    found = rows(map_blocks(df, "n long, size long", size))
    assert sum(n for n, _ in found) == 3000
    assert max(size for _, size in found) < 5_000_000  # 30 MB in one batch by rows


def test_profiles_of_a_block_take_little_memory():
    """A block with every trigram of 26 letters: some 18 thousand vectors, which never stand side by side."""
    data = np.random.default_rng(7).integers(97, 123, 1 << 19).astype(np.uint8)
    offsets = np.linspace(0, len(data), 257).astype(np.int64)
    langid.profiles(offsets[:2], data[:offsets[1]])
    tracemalloc.start()
    try:
        vectors, has = langid.profiles(offsets, data)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert has.all() and peak < 80_000_000
    for i in (0, 100, 255):
        alone, _ = langid.profiles(offsets[i:i + 2] - offsets[i], data[offsets[i]:offsets[i + 1]])
        assert (alone[0] == vectors[i]).all()


def test_near_copies_are_compared_once_for_all_their_lists(spark, monkeypatch):
    """Near copies share nearly all lists, and go to blocks under few hubs, not under each list."""
    rng = np.random.default_rng(5)
    base, texts = words(9, 60).split(), []
    for i in range(120):
        w = list(base)
        for p in rng.integers(0, 60, i % 9):
            w[p] = f"z{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    df, write, held = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), neardup.staged, {}

    def kept(df, name):
        held[name] = write(df, name)
        return held[name]

    monkeypatch.setattr(neardup, "staged", kept)
    assert rows(neardup.near_duplicates(df, 2)) == sorted(brute_near(texts, 2), key=str)
    assert held["open"].count() < held["lists"].count() / 4


def test_components_of_any_graph(spark):
    """Stars, chains, rings and random edges against a search; an edge to itself joins nothing."""
    rng = np.random.default_rng(8)
    edges = [(5, 5), (100, 7), (7, 101), (100, 102)] + [(200 + i, 201 + i) for i in range(40)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    edges += [(500 + int(a), 500 + int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(400, 400 + i) for i in range(1, 30)] * 2
    of = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in of:
        for a, b in edges:
            if a != b:
                of[a] = of[b] = min(of[a], of[b])
    found = rows(components(spark.createDataFrame(edges, "a long, b long")))
    assert sorted(tuple(r) for r in found) == sorted(of.items())
