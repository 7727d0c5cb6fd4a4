"""What the corpus operators share with the rest of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources.store import collected, drop, drop_all_but, drop_paths, scope, shared_dir, tidy, written

__all__ = ["collected", "drop", "drop_all_but", "drop_paths", "hidden", "scope", "shared_dir", "table", "tidy", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hidden(docs: DataFrame) -> tuple[DataFrame, dict]:
    """``docs`` with its columns under names of our own, and these by the columns' names: nothing that is joined to it can clash."""
    own = {c: f"__own_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own
