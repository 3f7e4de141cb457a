"""Annotated documents as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import surface

#: The most frequent entity of an anchor may be sent to every task up to so many anchors.
MOST_ANCHORS = 200_000


def highlighted(phrase: Column, is_entity: Column, kind: Column) -> Column:
    """The phrase, underlined if it is an entity, with its type where it has one."""
    mark = F.concat(F.lit('<u class="entity">'), phrase, F.lit("</u>"))
    return F.when(~is_entity, phrase).when(kind.isNull(), mark).otherwise(F.concat(mark, F.lit(' <span class="type">('), kind, F.lit(")</span>")))


def _document(spans: DataFrame, html: Column, keys: list[str]) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("start", html.alias("html"))))
    return spans.groupBy(*keys).agg(ordered.alias("o")).select(*keys, F.array_join(F.transform("o", lambda x: x["html"]), " ").alias("html"))


def entity_html(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, html: spans (start, phrase, is_entity, kind) in order."""
    return _document(spans, highlighted(F.col("phrase"), F.col("is_entity"), F.col("kind")), keys)


def linked_html(spans: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    """As entity_html; an entity with a candidate links to its most frequent one. top: anchor, entity."""
    small = top.select("anchor").limit(MOST_ANCHORS + 1).count() <= MOST_ANCHORS
    top = top.select(F.col("anchor").alias("phrase"), "entity")
    found = spans.join(F.broadcast(top) if small else top, "phrase", "left")
    plain = highlighted(F.col("phrase"), F.col("is_entity"), F.col("kind"))
    link = F.concat(F.lit('<a href="'), surface.entity_link(F.col("entity")), F.lit('">'), F.col("phrase"), F.lit("</a>"))
    return _document(found, F.when(F.col("is_entity") & F.col("entity").isNotNull(), link).otherwise(plain), keys)
