"""The change history over the driver's tables: commits, changes, credits, files and people.

An order is a commit, its lines are changes of files, parts are files, nations
are people; see the README for the mapping. Every view is lazy.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import staged

SUBJECTS = {"1-URGENT": "fix(core): order flow", "2-HIGH": "feat: order entry, totals and tax lines", "3-MEDIUM": "Refactor pricing", "4-NOT SPECIFIED": "docs: describe orders"}


def path_of(part: DataFrame) -> DataFrame:
    """part with the path its columns stand for."""
    stem = F.concat(F.when(F.col("p_size") % 10 == 0, "test_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")))
    kind = F.when(F.col("p_size") % 7 == 0, ".md").when(F.col("p_size") % 7 == 1, ".json").otherwise(".py")
    return part.withColumn("path", F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.lower("p_type"), F.lit("/"), stem, kind))


class History:
    """Views of a change history in a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.is_held = spark, sf_dir, False

    def held(self) -> History:
        """The same history with its changes and credits written once, for a query that uses them several times."""
        if self.is_held:
            return self
        out = History(self.spark, self.sf_dir)
        out.is_held = True
        out.changes = staged(self.changes)
        out.credits = staged(out.credits)
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def paths(self) -> DataFrame:
        return path_of(self.table("part"))

    @cached_property
    def commits(self) -> DataFrame:
        """hash, pos, date, author, subject of every commit, with or without files."""
        subject = F.lit('Revert "Refactor pricing"')
        for priority, text in reversed(SUBJECTS.items()):
            subject = F.when(F.col("o_orderpriority") == priority, text).otherwise(subject)
        suffix = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" (#"), F.col("o_orderkey") % 997, F.lit(")"))).otherwise("")
        people = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("author"))
        return self.table("orders").join(people, "o_custkey").select(F.concat(F.lit("o"), "o_orderkey").alias("hash"), F.col("o_orderkey").alias("pos"), F.to_date("o_orderdate").alias("date"), "author", F.concat(subject, suffix).alias("subject"))

    @cached_property
    def changes(self) -> DataFrame:
        """One row for each commit and path, with the commit's header."""
        # dealt out by commit once, for the groups and the join
        lines = self.table("lineitem").join(self.paths.select(F.col("p_partkey").alias("l_partkey"), "path"), "l_partkey").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("pos"), "path")
        counted = lines.agg(F.sum("l_quantity").cast("long").alias("added"), F.sum(F.floor(F.col("l_quantity") * F.col("l_discount") * 10)).cast("long").alias("deleted"))
        return counted.join(self.commits, "pos").select("hash", "pos", "date", "author", "subject", "path", "added", "deleted")

    @cached_property
    def people(self) -> DataFrame:
        """hash, pos, person, position, people: the author at position 0, then co-authors by name."""
        first = self.table("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("pos"), "l_suppkey")
        named = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("other"))
        others = first.join(named, "l_suppkey").groupBy("pos").agg(F.sort_array(F.collect_set("other")).alias("others"))
        held = self.commits.join(others, "pos", "left").withColumn("all", F.concat(F.array("author"), F.filter(F.coalesce("others", F.array()), lambda x: x != F.col("author"))))
        return held.select("hash", "pos", "date", F.size("all").alias("people"), F.posexplode("all").alias("position", "person"))

    @cached_property
    def credits(self) -> DataFrame:
        """changes times people, lines shared in whole numbers."""
        from ..functions.exprs import apportioned

        shared = self.changes.drop("date", "author").join(self.people, ["hash", "pos"])
        return shared.select("hash", "pos", "date", "person", "position", "path", apportioned(F.col("added"), F.col("people"), F.col("position")).alias("added"), apportioned(F.col("deleted"), F.col("people"), F.col("position")).alias("deleted"))

    @cached_property
    def size_files(self) -> DataFrame:
        return self.paths.groupBy("path").agg(F.sum(F.col("p_size") * 10).alias("code"), F.sum(F.col("p_size") % 50).alias("complexity"))

    @cached_property
    def tree(self) -> DataFrame:
        """Paths present at the end."""
        return self.paths.where(F.col("p_partkey") % 10 != 0).select("path").distinct()

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def now(self) -> DataFrame:
        """One row: the date of the last commit."""
        return self.commits.agg(F.max("date").alias("now"))

    @cached_property
    def ranked_docs(self) -> DataFrame:
        """Labelled documents: id, cost, outcome (quality), toxic, lang, source and rank by length."""
        return self.table("documents").join(self.table("labels"), "doc_id").select("doc_id", F.col("n_chars").alias("cost"), F.col("quality").alias("outcome"), "toxic", "lang", "source")
