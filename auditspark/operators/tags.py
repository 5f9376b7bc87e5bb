"""New versions behind a stored cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tag_triggers(tags: DataFrame, cursors: DataFrame, project: str = "project", tag: str = "tag", order: str = "created") -> DataFrame:
    """``project``, old, new for every tag that is newer than the project's cursor,
    each chained to the tag before it.

    A project without a cursor, or whose cursor is no longer among its tags, gives
    no trigger: it is only re-based (see ``next_cursors``).  Projects are the unit of
    the window; their tags are release lists.
    """
    w = Window.partitionBy(project).orderBy(order, tag)
    placed = tags.select(project, tag, F.row_number().over(w).alias("place"), F.lag(tag).over(w).alias("old"))
    known = placed.join(cursors.select(F.col(project), F.col("cursor")), project)
    base = known.where(F.col(tag) == F.col("cursor")).groupBy(project).agg(F.max("place").alias("base"))
    return placed.join(base, project).where(F.col("place") > F.col("base")).select(project, "old", F.col(tag).alias("new"))


def next_cursors(tags: DataFrame, cursors: DataFrame, project: str = "project", tag: str = "tag", order: str = "created") -> DataFrame:
    """The cursor of every project after a poll: its newest tag, or the old cursor where it has no tags."""
    newest = tags.groupBy(project).agg(F.max_by(tag, F.struct(order, tag)).alias("newest"))
    return newest.join(cursors, project, "full_outer").select(project, F.coalesce("newest", "cursor").alias("cursor"))
