"""A corpus from raw documents to tokens: five stages, each written as Parquet and read again as the next one's input.

Language ID drops what no language claims; of near duplicates one document stays; repeated passages are
cut; sources are mixed to their targets in training order; texts become token ids.

What a stage writes on its way lies in a folder of its own. The next stage called over the same ``sf_dir`` removes
it, unless its own ``docs`` still read from there: a stage's result must be written before another one starts.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetaudit.functions.stage import discard, new_folder, staged, staged_in
from fleetaudit.llm import bpe, langid, mixing, neardup, recompress
from fleetaudit.llm.queries import tokenizer_path
from fleetaudit.session import prepare


def _measured(docs: DataFrame) -> DataFrame:
    """Documents whose texts have changed, with their lengths put right."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_unknown(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(recompress.remove_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(mixing.training_order(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.with_tokens(docs, tokenizer_path())


# Place of the stage and folder of what it wrote on its way, by session, thread and ``sf_dir``.
_left: dict[tuple, list[tuple[int, str]]] = defaultdict(list)


def _in_turn(place: int, name: str, stage: Callable) -> Callable:
    """``stage`` with a folder of its own, removing those of earlier stages that ``docs`` do not read."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left[spark.sparkContext.applicationId, get_ident(), sf_dir]
        earlier = [x for x in left if x[0] < place]
        read = docs.inputFiles() if earlier else []
        for x in earlier:
            own = x[1].rsplit("/", 1)[1]
            if not any(own in file for file in read):
                discard(spark, x[1])
                left.remove(x)
        folder = new_folder(spark, name)
        left.append((place, folder))
        with staged_in(folder):
            return stage(spark, docs, sf_dir)
    return run


STAGES = [(name, _in_turn(place, name, stage)) for place, (name, stage) in enumerate([
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("bpe", tokenize),
])]

# The language model, the hash order and the merges have no SQL form; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = prepare(spark, asked_only=False).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out, folder = stage(spark, docs, sf_dir), new_folder(spark, f"{name}-result")
        with staged_in(folder):
            docs = staged(out, name)
        if before:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
