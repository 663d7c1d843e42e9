"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.common import discard, stash


def _mark(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for links ``(a, b)`` of longs: every node that has a link, and the smallest node it is connected to.

    Each round ties all larger neighbours of a node to the smallest one, then all smaller ones (Kiveris et al. 2014),
    until nothing changes; the number of rounds grows with the logarithm of the longest path.  Minima are
    pre-aggregated and the joins back are plain equi-joins, so a node with very many links may be split.  Each round's
    links are written to the shared folder.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stash(links, "links")
    mark = _mark(links)
    while mark[0]:
        # large star: everything larger than a node goes to the least of its neighbourhood
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: what is smaller than a node, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        tied = large.join(least, large["a"] == least["u"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                                                  F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("l"))
        after = stash(tied.select("l.a", "l.b").where("a <> b").distinct(), "links")
        new = _mark(after)
        discard(links)
        links, same, mark = after, new == mark, new
        if same:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
