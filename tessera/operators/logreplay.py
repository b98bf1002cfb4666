"""Recovery passes over a log as a table: lsn, txn, kind, rid, val. Kinds are BEGIN, INSERT, UPDATE, DELETE, COMMIT, ABORT, CHECKPOINT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA = ("INSERT", "UPDATE", "DELETE")


def analysis(log: DataFrame) -> DataFrame:
    """(txn, outcome): COMMITTED, ABORTED, or ACTIVE for those that a crash cut off.

    Where the log has a column ``active`` (the transactions that a CHECKPOINT found open), the last checkpoint sets who is active: those
    it lists and those with an entry after it. Who had ended by then is as it was."""
    ends = log.groupBy("txn").agg(F.max(F.col("kind") == "COMMIT").alias("committed"), F.max(F.col("kind") == "ABORT").alias("aborted"), F.max("lsn").alias("last"))
    outcome = F.when(F.col("committed"), "COMMITTED").when(F.col("aborted"), "ABORTED").otherwise("ACTIVE").alias("outcome")
    if "active" not in log.columns:
        return ends.filter("txn is not null").select("txn", outcome)
    point = log.filter("kind = 'CHECKPOINT'").agg(F.max("lsn").alias("point"), F.max_by("active", "lsn").alias("active"))
    listed = point.select(F.explode("active").alias("txn"), "point")
    ends = ends.filter("txn is not null").join(listed, "txn", "full").crossJoin(F.broadcast(point.select(F.coalesce("point", F.lit(-(1 << 62))).alias("since"))))
    ended = F.coalesce(F.col("committed") | F.col("aborted"), F.lit(False))
    return ends.filter(ended | F.col("point").isNotNull() | (F.col("last") > F.col("since"))).select("txn", outcome)


def redo(log: DataFrame) -> DataFrame:
    """(rid, val): the last change of each row by a committed transaction, without the rows that it deletes.

    The last change is a maximum, combined before the shuffle in a hash table of numbers, rather than a sort of each row's history. Only
    entries that commit are grouped to find the winners."""
    winners = log.filter("kind = 'COMMIT'").select("txn").distinct()
    data = log.filter(F.col("kind").isin(*DATA)).join(winners, "txn", "left_semi")
    last = data.groupBy("rid").agg(F.max_by("val", "lsn").alias("val"), F.max_by(F.col("kind") == "DELETE", "lsn").alias("gone"))
    return last.filter("not gone").select("rid", "val")


def undo(log: DataFrame) -> DataFrame:
    """(txn, undone): how many changes of each transaction without an outcome are never applied."""
    losers = analysis(log).filter("outcome = 'ACTIVE'").select("txn")
    return log.filter(F.col("kind").isin(*DATA)).join(losers, "txn", "left_semi").groupBy("txn").agg(F.count(F.lit(1)).alias("undone"))


def visible(rows: DataFrame, snapshot: int, created: str = "created", deleted: str = "deleted") -> DataFrame:
    """The versioned rows that a snapshot sees: made by then, and not deleted (0) or deleted later."""
    return rows.filter((F.col(created) <= snapshot) & ((F.col(deleted) == 0) | (F.col(deleted) > snapshot)))
