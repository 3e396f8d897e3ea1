"""The operators bound to the given tables, with production parameters, and SQL where it can say the same."""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import bpe, bwt, bytelevel, fingerprint, infill, langid, mixing, mtree, neardup, periodic, quality, recompress, toxicity
from .text import map_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    """Place of the vocabulary file: $LLM_TOKENIZER, else the installed public file."""
    if "LLM_TOKENIZER" in os.environ:
        return os.environ["LLM_TOKENIZER"]
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, folder: fn(prepare(spark, asked_only=False), folder)
    return fn


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query
def op1_multiset_fingerprint(spark, folder):
    return fingerprint.edits(_read(spark, folder, "documents"))


@query
def op2_bpe(spark, folder):
    return bpe.token_digests(_read(spark, folder, "documents"), tokenizer_path())


@query
def op3_quality_bayes(spark, folder):
    docs = _read(spark, folder, "documents")
    return quality.score(docs, _read(spark, folder, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


@query
def op6_mixing(spark, folder):
    mixed = mixing.mix(_read(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


ORACLES["op6_mixing"] = r"""
WITH sized AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
                      md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][number % 3 + 1] AS weight, [CAST(1.5 AS DOUBLE), 1.0, 0.5][number % 3 + 1] AS opening, 2 * source_size AS cap FROM per),
levels AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM weighed),
level AS (SELECT max(own_level) AS level FROM levels WHERE cap >= own_level * weight),
plan AS (SELECT l.*, least(CAST(cap AS DOUBLE), coalesce(level * weight, cap)) AS target FROM levels l, level),
placed AS (SELECT s.doc_id, s.size, s.place, p.source_size, p.target, p.opening, CAST(round(p.target) AS BIGINT) AS whole,
                  sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
           FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
taken AS (SELECT *, least(greatest(whole - start, 0), size) AS first_round, least(greatest(whole - source_size - start, 0), size) AS second_round FROM placed),
timed AS (SELECT *, CASE WHEN first_round > 0 THEN least(CAST(start AS DOUBLE) / whole, 1.0) END AS x FROM taken)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(first_round + second_round AS BIGINT) AS taken,
       CAST(floor(CASE WHEN opening = 1 THEN x ELSE (sqrt(opening * opening + 4 * (1 - opening) * x) - opening) / (2 * (1 - opening)) END * 1e9) AS BIGINT) AS position
FROM timed
"""


@query
def op7_mtree_top_k(spark, folder):
    return mtree.top_k(_read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op7_mtree_top_k"] = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
           FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query
def op9_language_id(spark, folder):
    docs = _read(spark, folder, "documents").select("doc_id", "text", "lang")
    prototypes = langid.learn(docs.where(~langid.in_fold("doc_id", 3, 1)))
    return langid.predict(docs.select("doc_id", langid.in_fold("doc_id", 3, 1).alias("held_out"), "text"), prototypes).drop("text")


@query
def op10_toxicity(spark, folder):
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    labels = _read(spark, folder, "labels").where("toxic is not null").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(toxicity.sample(docs, labels.where(~langid.in_fold("doc_id", 5, 0))))
    return toxicity.score(docs.withColumn("held_out", langid.in_fold("doc_id", 5, 0)), model).select("doc_id", "held_out", "score", "predicted")


@query
def op4_bottom_k_near_duplicates(spark, folder):
    return neardup.near_duplicates(_read(spark, folder, "documents"), width=2)


ORACLES["op4_bottom_k_near_duplicates"] = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM docs),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
classes AS (SELECT min(doc_id) AS id, n, list_sort(s) AS s FROM sized WHERE n > 0 GROUP BY ALL),
held AS (SELECT id, n, unnest(s) AS g FROM classes),
common AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM held a JOIN held b ON a.g = b.g AND a.id < b.id
           AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
part AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a),
named AS (SELECT c.n, c.s, p.component_id FROM classes c JOIN part p USING (id))
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM sized d LEFT JOIN named c ON d.n = c.n AND list_sort(d.s) = c.s
"""


@query
def op8_recompression(spark, folder):
    return recompress.removal_digests(_read(spark, folder, "documents"))


ORACLES["op8_recompression"] = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM later, range(20) t(j)),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS place, unnest(w) AS word FROM docs),
kept AS (SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS t FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.place = g.place GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query
def op5_bwt_merge(spark, folder):
    return bwt.removal_digests(_read(spark, folder, "documents"))


@query
def op11_byte_level_bpe(spark, folder):
    import public_tokenizers
    path = os.environ.get("LLM_RANKS") or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytelevel.token_digests(_read(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query
def op12_fill_in_middle(spark, folder):
    made = infill.restore(infill.fill_in_middle(_read(spark, folder, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
                 CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM hashed),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn),
formed AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                  substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM formed
"""

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; texts of one id in ten have a tail of repeated words, as the contract of the query sets it."""
    def run(batch):
        texts = []
        for key, text in zip(*(c.to_pylist() for c in batch.columns)):
            h = zlib.crc32(b"" if key is None else str(key).encode())
            words = _WORD.findall(text or "") if h % 10 == 0 else []
            if words:
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = " ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_blocks(docs.select("doc_id", "text"), f"doc_id {kind}, text string", run)


@query
def op13_periodic_runs(spark, folder):
    found = periodic.periodic_runs(_with_planted_runs(_read(spark, folder, "documents")))
    best = periodic.longest("runs")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(periodic.listing("runs").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


# Lags are taken from k-grams that recur, k by class of periods (5, 18, 57, ... words; each 3 times the last
# class's largest period plus 3); every lag found is then compared over the whole document.
ORACLES["op13_periodic_runs"] = r"""
WITH RECURSIVE classes(low, k) AS (SELECT CAST(1 AS BIGINT), CAST(5 AS BIGINT) UNION ALL SELECT k + 1, 3 * (k + 1) FROM classes WHERE k < 1000000),
bytes AS (SELECT doc_id, text, list_transform(range(1, length(coalesce(CAST(doc_id AS VARCHAR), '')) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)) AS b FROM documents),
hashed AS (SELECT doc_id, text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
           lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, CAST(3988292384 AS BIGINT)) ELSE y >> 1 END))) AS h FROM bytes),
split AS (SELECT row_number() OVER () AS id, doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM hashed),
placed AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM split),
docs AS (SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
                                    ELSE w END AS w FROM placed),
words AS (SELECT id, unnest(range(n)) AS i, unnest(w) AS word FROM docs),
grams AS (SELECT id, low, k, i, hash(array_to_string(w[i + 1:i + k], ' ')) AS gram FROM (SELECT d.id, d.w, c.low, c.k, unnest(range(d.n - c.k + 1)) AS i FROM docs d JOIN classes c ON d.n >= 4 * c.low AND d.n >= c.k)),
lags AS (SELECT DISTINCT id, lag FROM (SELECT id, low, k, i - lag(i) OVER (PARTITION BY id, k, gram ORDER BY i) AS lag FROM grams) WHERE lag BETWEEN low AND k),
same AS (SELECT l.id, l.lag, x.i, x.i - row_number() OVER (PARTITION BY l.id, l.lag ORDER BY x.i) AS stretch
         FROM lags l JOIN words x ON x.id = l.id JOIN words y ON y.id = l.id AND y.i = x.i + l.lag AND y.word = x.word),
stretches AS (SELECT id, lag, min(i) AS start, count(*) + lag AS length FROM same GROUP BY id, lag, stretch HAVING count(*) + lag >= greatest(6, 4 * lag)),
runs AS (SELECT id, start, length, min(lag) AS period FROM stretches GROUP BY id, start, length),
listed AS (SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY id ORDER BY length DESC, start, period) = 1),
gone AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT d.doc_id, CAST(coalesce(l.n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period,
       CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l USING (id) LEFT JOIN best b USING (id) LEFT JOIN kept k USING (id)
"""
