"""Who is who: names and addresses merged into people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import graph


def tokens(name: Column) -> Column:
    """Words of three letters or more of a name, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: F.length(x) >= 3))


def squash(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def is_bot(name: Column | str, email: Column | str) -> Column:
    name, email = (F.col(x) if isinstance(x, str) else x for x in (name, email))
    return F.coalesce(F.endswith(name, F.lit("[bot]")) | name.rlike(X.BOT_NAME) | F.contains(email, F.lit("[bot]@")), F.lit(False))


def shared_mailbox(email: Column | str) -> Column:
    email = F.col(email) if isinstance(email, str) else email
    return (F.coalesce(email, F.lit("")) == "") | F.substring_index(email, "@", 1).rlike(X.NO_REPLY)


def forge_login(email: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(email), r"^(?:\d+\+)?([a-z0-9-]+)@users\.noreply\.", 1), F.lit(""))


def shared_words(people: DataFrame) -> DataFrame:
    """word, names: words that full names of different people have in common."""
    full = people.select("name", tokens(F.col("name")).alias("t")).where(F.size("t") >= 2).distinct()
    return full.select("name", F.explode("t").alias("word")).groupBy("word").agg(F.countDistinct("name").alias("names")).where("names > 1")


def merge(people: DataFrame) -> DataFrame:
    """name, email, commits, head_name, head_email of (name, email, commits): rows that share a key are one person.

    Keys: an address that is no shared mailbox; a forge login equal to a
    squashed name or mailbox; a full name of two words or more in any order.
    A key with n rows links each to its least, so groups cost no pairs.
    """
    rows = people.groupBy("name", "email").agg(F.sum("commits").alias("commits")).withColumn("id", F.concat_ws("\u001f", F.coalesce("name", F.lit("")), F.coalesce("email", F.lit(""))))
    box, words = F.lower(F.substring_index("email", "@", 1)), tokens(F.col("name"))
    keys = F.array_compact(F.array(
        F.when(~shared_mailbox("email"), F.concat(F.lit("mail:"), F.lower("email"))),
        F.when(F.size(words) >= 2, F.concat(F.lit("name:"), F.array_join(F.sort_array(words), " "))),
        F.when(forge_login(F.col("email")).isNotNull(), F.concat(F.lit("login:"), F.regexp_replace(forge_login(F.col("email")), "-", ""))),
        F.when(~shared_mailbox("email") & (F.length(box) >= 6), F.concat(F.lit("login:"), F.regexp_replace(box, "[^a-z0-9]", ""))),
        F.when((F.size(words) >= 2) & (F.length(squash(F.col("name"))) >= 6), F.concat(F.lit("login:"), squash(F.col("name")))),
    ))
    keyed = rows.select("id", F.explode(F.array_distinct(keys)).alias("key"))
    heads = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    links = keyed.join(heads, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    groups = graph.components(links)
    placed = rows.join(groups, rows.id == groups.node, "left").select("name", "email", "commits", F.coalesce("root", "id").alias("group"))
    best = placed.groupBy("group").agg(F.min_by(F.struct("name", "email"), F.struct((-F.col("commits")).alias("n"), "name", "email")).alias("head"))
    return placed.join(best, "group").select("name", "email", "commits", F.col("head.name").alias("head_name"), F.col("head.email").alias("head_email"))


def tools(people: DataFrame, trailer_share: float = 0.9) -> DataFrame:
    """email of mailboxes that are tools: bare no-reply ones with two names or more, or credited by trailers nearly always."""
    bare = people.where(F.col("email").rlike("(?i)^(?:no-?reply|donotreply|do-not-reply)@"))
    held = bare.groupBy("email").agg(F.countDistinct("name").alias("names"), X.ratio(F.sum("trailers"), F.sum("commits")).alias("share"))
    return held.where((F.col("names") >= 2) | (F.col("share") >= trailer_share)).select("email")
