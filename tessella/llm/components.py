"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import mark, release, written


def connected(links: DataFrame) -> DataFrame:
    """(id, label) for every id in links (a, b), label the least id reachable. Links and labels stay distributed.

    Every round takes the least label of a node's neighbours, then the label of its label, so the rounds are about the
    logarithm of the longest path; each is written to the shared folder. No links: no rows.
    """
    begun = mark()
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        of = lower.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        jumped = written(lower.join(of, "low").select("id", F.col("lower").alias("label"), (F.col("lower") != F.col("label")).alias("changed")), "labels")
        labels = jumped.select("id", "label")
        if not jumped.filter("changed").limit(1).count():
            release(links.sparkSession, begun, keep=1)
            return labels
