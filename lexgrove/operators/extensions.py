"""Functions that SQL can call once they are registered: a table function over wikitext and a scalar over titles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexgrove.operators.linking import bracketed

CATEGORY = "Category:"


class WikiLinks:
    """Rows (entity, anchor) of a text's links of one or two parts, links around links included."""

    def eval(self, text: str | None) -> Iterator[tuple[str, str]]:
        for link in bracketed(text):
            parts = link.split("|")
            if len(parts) == 1:
                yield link, link.rpartition(CATEGORY)[2] if link.startswith(CATEGORY) else link
            elif len(parts) == 2:
                yield parts[0], parts[1]


def register(spark: SparkSession) -> None:
    """Makes wikilinks(text), a table function, and plain_title(title) known to the session's SQL."""
    spark.udtf.register("wikilinks", F.udtf(WikiLinks, returnType="entity string, anchor string"))

    @F.pandas_udf("string")
    def plain_title(titles: pd.Series) -> pd.Series:
        return titles.str.replace("_", " ").str.strip()

    spark.udf.register("plain_title", plain_title)
