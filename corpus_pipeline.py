"""A corpus pipeline: quality rules, line dedup, near duplicates, decontamination, mix.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns the columns of ``documents``; the last returns the mix, a row for
each document left with all its copies, their shards and places. Stages may be
composed with or without a write between them: no stage removes a table. ``run``
writes what a stage returns and reads it again for the next one; what the stage
worked on, and what it was given, go when its result stands.

Defined cases, for all stages: null, empty and very long texts, null ids,
languages and sources, repeated rows, ties and empty tables are taken as the
operators define them; other columns, whatever their names, come out as they
went in, but for the last stage, which leaves them out. No stage drops a
repeated row but near duplicates, where one row of each group stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from marlstone.llm import decontam, jaccard, line_dedup, mixing, quality
from marlstone.llm._shared import drop_paths, scope, table, written


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null texts are among them."""
    return quality.keep_good(docs)


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one; ``n_chars`` follows the text. No document goes, a null text stays null."""
    return line_dedup.dedup_lines(docs, recount="n_chars" if "n_chars" in docs.columns else None)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least id: five-word shingles, similarity 0.8. Texts without words are no group."""
    return jaccard.keep_one(docs, 5, 80, 100)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; texts without words stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: what it takes of each document, and in which shards and places. Documents of which it takes nothing have no copies."""
    return mixing.mix_report(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Components of near duplicates and keyed hashes are not expressed in SQL; tests hold each stage against its own.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs, given = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scope() as worked:
            result = stage(spark, docs, sf_dir)
        with scope() as stands:
            docs = written(result, f"stage-{name}")
        drop_paths([*worked, *given])
        given = stands
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
