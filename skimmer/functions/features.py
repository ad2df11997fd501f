"""Quality features of a message, as Column expressions named as in the training file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ["Topic", "Url", "Mention", "WordCount", "Capital", "Followers", "Statuses", "CharacterPerWord", "ellipsis", "RetweetCount", "RetweetLevel", "Personal"]


def has_topic(text: Column) -> Column:
    return text.rlike(r"#\w+")


def filled(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def word_count(text: Column) -> Column:
    """Parts between white space; trailing empty parts don't count, a leading one does. White space only: none."""
    parts = F.size(F.split(F.regexp_replace(text, r"\s+$", ""), r"\s+"))
    return F.when(F.regexp_replace(text, r"\s+$", "") == "", F.when(text == "", 1).otherwise(0)).otherwise(parts)


def capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\s[A-Z][a-z]+"))


def log_count(n: Column) -> Column:
    return F.when(n > 0, F.log10(n.cast("double"))).otherwise(F.lit(0.0))


def characters_per_word(text: Column) -> Column:
    """Whole number; null without words."""
    return F.floor(F.try_divide(F.length(text), word_count(text))).cast("int")


def has_ellipsis(text: Column) -> Column:
    return text.rlike(r"\.\.+")


def retweet_count(n: Column) -> Column:
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))


def retweet_level(n: Column) -> Column:
    """Decimal digits of the count; 0 for none."""
    count = retweet_count(n)
    return F.when(count > 0, F.length(count.cast("string"))).otherwise(0)


def is_personal(text: Column) -> Column:
    return text.rlike(r"I\s|my\s|\sme")


def of_message() -> dict[str, Column]:
    """All twelve, on a message of schema.MESSAGE; the retweeted text and counts where there are any."""
    again, user = F.col("retweeted_status"), F.col("user")
    text = F.coalesce(again["text"], F.col("text"))
    pick = lambda name: F.when(again.isNotNull(), again["user"][name]).otherwise(user[name])
    return {
        "Topic": has_topic(text), "Url": filled(F.col("entities.urls")), "Mention": filled(F.col("entities.user_mentions")),
        "WordCount": word_count(text), "Capital": capitals(text), "Followers": log_count(pick("followers_count")),
        "Statuses": log_count(pick("statuses_count")), "CharacterPerWord": characters_per_word(text), "ellipsis": has_ellipsis(text),
        "RetweetCount": retweet_count(again["retweet_count"]), "RetweetLevel": retweet_level(again["retweet_count"]), "Personal": is_personal(text),
    }
