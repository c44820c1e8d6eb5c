"""The corpus pipeline: documents through language ID, line dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`, and
other columns that `docs` has. The tables that a stage stages are deleted once a later stage gets its written result:
the first column of a result carries, as metadata, which tables were made for it, and a stage that finds such a mark on
`docs` deletes those tables, unless `docs` itself still reads them, as in a chain of stages without writes between.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import langid, line_dedup, mixing, near_dedup, packing
from panelforge.llm.common import Staging, free_name, quoted, staged, table

#: A language is taken for unknown below this mean probability. It is low on purpose: a clean text that mixes two of the
#: languages stays, and so may texts in none of them, since a softmax over known languages has no class for the rest.
LEAST_SCORE = 0.3
MARK = "staged_for"

_made: dict[str, Staging] = {}


def stage(f):
    """Delete what was staged for `docs`, if it is written; run the stage; mark its result with what it staged."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mark = next((x.metadata[MARK] for x in docs.schema if MARK in x.metadata), None)
        before = _made.pop(mark, None)
        with Staging() as made:
            if before is not None and before.read_by(docs):
                made.tables += before.tables
            elif before is not None:
                before.release()
            out = f(spark, docs, sf_dir)
        mark = uuid.uuid4().hex
        _made[mark] = made
        first, *rest = out.schema
        return out.select(quoted(first.name).alias(first.name, metadata={**first.metadata, MARK: mark}), *(quoted(x.name) for x in rest))

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network recognises; null texts, those without a letter, or below LEAST_SCORE, go.

    Repeated rows are judged alike. An empty table gives an empty one. Very long texts are judged whole.
    """
    label, score = free_name(docs, "language_"), free_name(docs, "language_score_")
    found = langid.identify(docs, langid.train(docs), label_col=label, score_col=score)
    return found.filter((F.col(label) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(label, score)


@stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one that loses all its text goes, null and empty texts stay.

    `n_chars`, where there is such a column, is that of the new text if lines were removed. Of repeated rows, the first
    keeps its passages.
    """
    lines, removed = free_name(docs, "lines_"), free_name(docs, "removed_")
    out = line_dedup.remove_repeated_lines(docs, lines_col=lines, removed_col=removed)
    out = out.filter((F.col(removed) == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(lines, removed)


@stage
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; of repeated rows one stays. Texts without words stay."""
    return near_dedup.drop_near_duplicates(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; one that it takes again comes again. A null source is a source of its own."""
    return mixing.mix(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences; a document that came twice is two documents."""
    return packing.pack_documents(docs, with_ids=False).drop("row")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mix", mix_sources),
    ("pack", pack),
]

#: The network of the first stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet and read again by the next, and then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with Staging() as written:
                docs = staged(docs, f"pipeline-{name}")
            if before is not None:
                before.release()
            before = written
    return docs
