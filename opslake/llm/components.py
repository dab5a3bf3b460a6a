"""Connected components of links, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake import session


def components(links: DataFrame) -> DataFrame:
    """(node, class) of the nodes in (a, b): class is the smallest node that links lead to.

    Each round takes the smallest class of the neighbours and then the class of that class, so chains halve. Classes
    are written between rounds and what rounds before have shuffled is released; only whether a class has changed comes
    to the driver.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = session.cut(links.where("a != b").select(ways).select("way.a", "way.b").distinct())
    classes = session.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")))
    while True:
        session.release(links.sparkSession)
        offered = both.join(classes, F.col("a") == F.col("node")).groupBy(F.col("b").alias("to")).agg(F.min("class").alias("offered"))
        taken = classes.join(offered, F.col("node") == F.col("to")).select("node", F.col("class").alias("was"), F.least("class", "offered").alias("class"))
        taken = session.cut(taken)
        if taken.where("class != was").isEmpty():  # no link joins two classes
            return taken.select("node", "class")
        above = taken.select(F.col("node").alias("up"), F.col("class").alias("higher"))
        jumped = taken.join(above, F.col("class") == F.col("up")).select("node", F.least("class", "higher").alias("class"))
        classes = session.cut(jumped)
