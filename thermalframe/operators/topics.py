"""Routing of messages by many topic patterns: the trie of the topics joined with the trie of the patterns.

``+`` stands for one level that is not empty, a last ``#`` for any number of further levels. Both tries are walked
together, one equi-join a level: a state is a pair of a topic prefix and a pattern prefix that fits it. Topics that begin
alike share their states, so the work follows the distinct prefixes, not the messages, and no pattern is tried against
a topic that has left it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalframe.session import cut_lineage


def _prefix(levels: Column, k: Column | int) -> Column:
    """The first ``k`` levels; equal for equal levels among prefixes of one length, as levels hold no slash."""
    return F.array_join(F.slice(levels, 1, k), "/")


def _patterns(routes: DataFrame) -> DataFrame:
    """(pattern, handler, walk, open): the levels before a last ``#``, and whether there is one."""
    rows = routes.select("pattern", "handler").where("pattern is not null").distinct()
    levels = F.split("pattern", "/")
    is_open = F.element_at(levels, -1) == "#"
    walk = F.when(is_open, F.slice(levels, 1, F.size(levels) - 1)).otherwise(levels)
    return cut_lineage(rows.select("pattern", "handler", walk.alias("walk"), is_open.alias("open")))


def match_topics(topics: DataFrame, routes: DataFrame, topic: str = "topic") -> DataFrame:
    """(topic, pattern, handler) of every distinct topic and every (pattern, handler) that fits it.

    Null topics and patterns fit nothing, repeated ones count once. A ``#`` before the last level raises ValueError.
    """
    patterns = _patterns(routes)
    depth, wrong = patterns.agg(F.max(F.size("walk")), F.count_if(F.array_contains("walk", "#"))).first()
    if wrong:
        raise ValueError("# must be the last level")
    known = cut_lineage(topics.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic")).distinct()
                        .withColumn("levels", F.split("topic", "/")))
    state = known.select(F.lit("").alias("begin"), F.lit("").alias("node")).distinct()
    found = []
    for k in range((depth or 0) + 1):
        ends = patterns.where(F.size("walk") == k).select(_prefix(F.col("walk"), k).alias("node"), "pattern", "handler", "open")
        found.append(state.join(ends, "node").select(F.lit(k).alias("depth"), "begin", "pattern", "handler", "open"))
        if k == (depth or 0):
            break
        levels, label = F.col("levels"), F.get("levels", F.lit(k))
        steps = known.where(F.size("levels") > k).select(
            _prefix(levels, k).alias("begin"), _prefix(levels, k + 1).alias("further"), label.alias("label")).distinct()
        labels = F.when(F.col("label") == "", F.array("label")).otherwise(F.array_distinct(F.array("label", F.lit("+"))))
        tried = state.join(steps, "begin").select(F.col("further").alias("begin"), "node", F.explode(labels).alias("label"))
        node = F.concat_ws("/", "node", "label") if k else F.col("label")
        nodes = patterns.where(F.size("walk") > k).select(_prefix(F.col("walk"), k + 1).alias("node")).distinct()
        state = cut_lineage(tried.select("begin", node.alias("node")).join(nodes, "node").select("begin", "node"))
    hits = reduce(DataFrame.unionByName, found)
    last = F.least(F.size("levels"), F.lit(depth or 0))
    begins = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("depth"), _prefix(F.col("levels"), k).alias("begin")))
    reach = known.select("topic", F.size("levels").alias("n"), F.inline(begins))
    return (reach.join(hits, ["depth", "begin"]).where(F.col("open") | (F.col("n") == F.col("depth")))
            .select(F.col("topic").alias(topic), "pattern", "handler"))


def route_by_trie(messages: DataFrame, routes: DataFrame, topic: str = "topic") -> DataFrame:
    """One row per (message, fitting pattern and handler), for route tables of any size."""
    return messages.join(match_topics(messages, routes, topic), topic).select(*messages.columns, "pattern", "handler")
