"""Byte-level BPE against tiktoken, fill-in-the-middle and periodic runs against plain Python."""
from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fleetaudit.llm import bytelevel, infill, periodic
from fleetaudit.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None, "", " \t\n", "one", "a a a a a", "a a a a a a", "x " + "ab cd " * 9 + "y", "it's 12 ½ 日本 🎉🎉" + " " * 40 + " 　x", "a" * 3001,
    "pre <P> fix", "<S>", "half <M", "naïve café – 東京 العربية\n\n" * 30, "\x1c\x85 ᠎ ", "\x00nul \U0010ffff", "<|endoftext|> y",
    "p q r s " * 12 + "p q x " + "b " * 70, " ".join(f"w{i % 977}" for i in range(9000)), "日本語" * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with repeated ids, null ids, repeated rows and extra columns of clashing names."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(None, "no key at all", None, None, None), (None, None, None, None, None), (3, "one", "en", "s", 1), (3, "other", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "ids", "runs", "form", "n", "output", "h1", "bytes"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytelevel.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bytelevel.Codec(bytelevel.specification(bytelevel.read_ranks(RANKS), PATTERN))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sha(b) -> str:
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# Byte-level BPE

def test_byte_level_digests(docs, pairs, nothing, library):
    want = []
    for key, text in pairs:
        ids = library.encode_ordinary(text or "")
        want.append((key, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text or "")))
    assert rows(bytelevel.token_digests(docs, RANKS, PATTERN)) == sorted(want, key=str)
    assert bytelevel.token_digests(nothing, RANKS, PATTERN).count() == 0


def test_byte_level_offsets_and_pieces(docs, pairs, nothing, library):
    encoded = bytelevel.encode(docs, RANKS, PATTERN).cache()
    assert sorted((r["doc_id"], r["ids"]) for r in encoded.collect() if r["doc_id"] is not None) == sorted((k, library.encode_ordinary(t or "")) for k, t in pairs if k is not None)
    texts = {}
    for key, text in pairs:
        texts.setdefault(key, []).append(text or "")
    for r in encoded.collect():
        if len(texts[r["doc_id"]]) > 1:
            continue
        text, tokens = texts[r["doc_id"]][0], [library.decode_single_token_bytes(i) for i in r["ids"]]
        ends = np.cumsum([len(t) for t in tokens])
        owner = np.repeat(np.arange(len(text)), [len(c.encode()) for c in text])  # code point of each byte
        assert r["starts"] == [owner[e - len(t)] for e, t in zip(ends, tokens)]
        assert r["ends"] == [owner[e - 1] + 1 for e in ends]
    back = bytelevel.decode(encoded, RANKS, PATTERN)
    for r in back.collect():
        assert r["text"] in texts[r["doc_id"]] and "".join(r["pieces"]) == r["text"] and bytes(r["bytes"]) == r["text"].encode()
    assert bytelevel.encode(nothing, RANKS, PATTERN).count() == 0
    assert bytelevel.decode(bytelevel.encode(nothing, RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_split_characters(codec, library):
    ids = library.encode_ordinary("x𝄞y")
    assert any(len(library.decode_single_token_bytes(i)) < 4 for i in ids[1:-1])  # the sign is split
    pieces = codec.pieces(np.array(ids))
    assert "".join(pieces) == "x𝄞y" and "�" not in "".join(pieces)
    assert codec.pieces(np.array(ids[:2]))[-1].endswith("�")  # cut inside the sign
    assert codec.decode(np.array(ids[:2])) == b"".join(map(library.decode_single_token_bytes, ids[:2]))


def test_segments_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bytelevel, "SEGMENT", 50)
    text = " ".join(t for t in TEXTS[:17] if t)
    assert len(list(bytelevel._segments([text, text]))) > 20
    for ids, spans in codec.encode([text, "", text]):
        assert ids.tolist() in ([], library.encode_ordinary(text))
        assert len(spans) == len(ids) and (not len(spans) or spans[-1][1] == len(text))


@pytest.mark.parametrize("seed", range(3))
def test_byte_level_random_code_points(codec, library, seed):
    draw = random.Random(seed)
    pools = [range(32, 127), range(0x80, 0x300), range(0x1F300, 0x1F700), range(0x4E00, 0x4F00), [9, 10, 13, 32, 0x85, 0xA0, 0x2003, 0x3000], range(0xE000, 0x110000)]
    texts = ["".join(chr(draw.choice(draw.choice(pools))) for _ in range(draw.randrange(60))) for _ in range(300)]
    assert [ids.tolist() for ids, _ in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_ranks_that_are_no_merges():
    ranks = {bytes([b]): b for b in range(256)}
    assert bytelevel.parents(b"abc", 257, {**ranks, b"bc": 256}) == (b"a", b"bc")
    with pytest.raises(ValueError):
        bytelevel.specification({**ranks, b"abc": 256}, PATTERN)
    with pytest.raises(ValueError):
        bytelevel.specification({b"a": 0}, PATTERN)


# Fill in the middle

def plain_infill(key, text):
    text, n = text or "", len(text or "")
    d = sha("1:" + ("" if key is None else str(key)))
    h = [int(d[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return key, n, form, a, b - a, out


def test_infill(docs, pairs, nothing):
    made = infill.fill_in_middle(docs)
    assert rows(made) == sorted((plain_infill(*x) for x in pairs), key=str)
    restored = infill.restore(made.withColumn("extra", F.lit(1)))
    assert sorted((r["doc_id"] or -1, r["restored"]) for r in restored.collect()) == sorted((k or -1, t or "") for k, t in pairs)
    assert infill.restore(infill.fill_in_middle(nothing)).count() == 0


def test_infill_all_forms(spark, docs, pairs):
    """Every text under many keys, with all forms among them."""
    many = spark.createDataFrame([(k, t) for k in range(100, 160) for t in TEXTS if t is None or len(t) < 900], "doc_id long, text string")
    got = rows(infill.fill_in_middle(many))
    assert got == sorted((plain_infill(r["doc_id"], r["text"]) for r in many.collect()), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = infill.restore(infill.fill_in_middle(many, plain_percent=0, spm_percent=50, marks=("‹p›", "‹s›", "‹m›")), marks=("‹p›", "‹s›", "‹m›"))
    assert sorted((r["doc_id"], r["restored"]) for r in back.collect()) == sorted((r["doc_id"], r["text"] or "") for r in many.collect())


def test_marks_at_the_seams():
    marks = tuple(m.encode() for m in infill.MARKS)
    for p, m, s in (("<", "P>", "<M"), ("a<S", ">", "<"), ("", "", ""), ("<<", "<S", "<P")):
        assert infill.parts(f"<P>{p}<S>{s}<M>{m}".encode(), "psm", marks) == (p + m + s).encode()
        assert infill.parts(f"<S>{s}<P>{p}<M>{m}".encode(), "spm", marks) == (p + m + s).encode()
    with pytest.raises(ValueError):
        infill.parts(b"text", "psm", marks)


@pytest.mark.parametrize("seed", range(4))
def test_units(seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choice("aé日🎉̀") for _ in range(draw.randrange(40))).encode() for _ in range(30)]
    data = b"".join(texts)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    units = infill.Units(offsets, np.frombuffer(data, np.uint8))
    ends = [i + 1 for i in range(len(data)) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80]
    assert units.rank(np.arange(len(data) + 1)).tolist() == [sum(e <= i for e in ends) for i in range(len(data) + 1)]
    assert units.select(np.arange(len(ends) + 1)).tolist() == [0, *ends]


# Periodic runs

def plain_runs(words, min_length=6, min_exponent=4):
    found = {}
    for q in range(1, len(words)):
        i = 0
        while i < len(words) - q:
            s = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(min_length, min_exponent * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    draw = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(draw.randrange(1, 5)):
            n, letters = draw.choice([0, 1, 5, 6, 7, 40, 130, 300]), draw.choice([1, 2, 3, 6])
            words = [draw.randrange(letters) for _ in range(n)]
            for _ in range(draw.randrange(4) if n > 8 else 0):
                a = draw.randrange(n)
                p = draw.randint(1, max(1, (n - a) // 3))
                for i in range(a, draw.randint(a, n)):
                    words[i] = words[a + (i - a) % p]
            docs.append(words)
        first = np.append(0, np.cumsum([len(w) for w in docs]))
        shape = draw.choice([(6, 4), (6, 4), (2, 3), (30, 3), (9, 5)])
        got = periodic.runs(np.array([x for w in docs for x in w], np.int64), first, *shape)
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, w in enumerate(docs) for r in plain_runs(w, *shape)]


def test_run_limits():
    assert periodic.runs(np.zeros(5, np.int64), np.array([0, 5])).tolist() == []
    assert periodic.runs(np.zeros(6, np.int64), np.array([0, 6])).tolist() == [[0, 0, 6, 1]]
    assert periodic.runs(np.array([1, 2] * 4), np.array([0, 8])).tolist() == [[0, 0, 8, 2]]
    assert periodic.runs(np.array([1, 2] * 4), np.array([0, 4, 8])).tolist() == []  # never across documents
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(6, np.int64), np.array([0, 6]), min_exponent=2)


def test_periodic_runs(docs, pairs, nothing):
    want = []
    for key, text in pairs:
        words = WORD.findall(text or "") if len(text or "") < 20_000 else None
        if words is None:
            continue
        found = plain_runs(words)
        want.append((key, len(words), [tuple(r) for r in found], collapsed(words, found)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()]
    assert sorted((g for g in got if g[1] < 9000), key=str) == sorted(want, key=str)
    assert [len(g[2]) for g in got if g[1] == 9000] == [1]  # 977 words, nine times over
    assert periodic.periodic_runs(nothing).count() == 0


def test_periodic_query(spark, tmp_path):
    draw = random.Random(5)
    rows = [(k, None if k == 7 else " ".join(draw.choice("abc") + "e" * draw.randrange(2) for _ in range(draw.randrange(90)))) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    for key, text in rows:
        words, h = WORD.findall(text or ""), zlib.crc32(str(key).encode())
        if h % 10 == 0 and words:
            a = (h // 10) % len(words)
            p = 1 + (len(words) - a) // (3 + (h // 10) % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert tuple(got[key]) == (key, len(found), *best, best[1] and 1000 * best[1] // best[2],
                                   sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(words, found)))
    assert any(r["n_runs"] for r in got.values())


def test_each_piece_is_encoded_once(codec, library, monkeypatch):
    """Ids as the library has them, whatever the white space; the tokenizer sees a piece of a batch once, and kept ones not again."""
    rng = random.Random(11)
    texts = ["".join(rng.choice(["word", "naïve", "x_", "12", "'s", " ", "  ", "\n", "\t ", "\u3000", "!", "日本", "a" * 70, "\u0301"]) for _ in range(60)) for _ in range(200)]
    texts += ["", " ", "a   b", "a \n  b", "_  _ x", "one two one two"]
    want = [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    monkeypatch.setattr(codec, "kept", {})
    assert codec.ids(texts) == want
    seen = []
    encoded = codec._encoded
    monkeypatch.setattr(codec, "_encoded", lambda batch: seen.extend(batch) or encoded(batch))
    assert codec.ids(["new words and new words"] * 50) == [np.array(library.encode_ordinary("new words and new words"), "<u4").tobytes()] * 50
    assert sorted(seen) == [" and", " new", " words", "new"]
    monkeypatch.setattr(bytelevel, "KEPT", 3)  # started anew at every call
    assert codec.ids(texts) == want
    assert all(len(p) < bytelevel.KEPT_LETTERS for p in codec.kept)
