"""Wiki pages as catalog documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text

# Labels of retired pages, and the date of those without any.
RETIRED = ["deprecated", "archived", "obsolete", "superseded", "retired"]
NO_DATE = "1970-01-01T00:00:00.000Z"


def normalize(pages: DataFrame, tenant: str = "default") -> DataFrame:
    """Documents for ``pages`` (id, title, url, author, created, updated, ancestors, acl_groups, labels, body).

    Labels stand in front of the body. A retired page ends with its last edit,
    and without a date long ago: that it is retired is known. Null lists are empty.
    """
    own = F.concat(F.lit("confluence:page:"), F.col("id"))
    names = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    retired = F.exists(names("labels"), lambda x: F.lower(F.trim(x)).isin(RETIRED))
    head = F.when(F.size(names("labels")) > 0, F.concat(F.lit("**Labels:** "), F.array_join("labels", ", "), F.lit("\n\n"))).otherwise("")
    return pages.select(
        own.alias("id"), F.lit(tenant).alias("tenant"), F.lit("confluence").alias("source"), "title", "url", "author",
        F.col("created").alias("created_at"), F.col("updated").alias("updated_at"), F.coalesce("created", "updated").alias("valid_from"),
        F.when(retired, F.coalesce("updated", "created", F.lit(NO_DATE))).alias("valid_to"),
        names("ancestors").alias("hierarchy"), names("acl_groups").alias("acl_groups"), F.lit("authored").alias("quality_tier"),
        F.concat(head, "body").alias("body"), F.coalesce(text.links(F.col("body"), own), F.array().cast("array<string>")).alias("links"),
    )
