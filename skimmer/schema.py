"""Declared schemas. Reading by schema prunes a message's other fields at the parser."""

from pyspark.sql import types as T

_COUNTS = [T.StructField("followers_count", T.LongType()), T.StructField("statuses_count", T.LongType())]

MESSAGE = T.StructType([
    T.StructField("id_str", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("timestamp_ms", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("screen_name", T.StringType()), T.StructField("lang", T.StringType()), *_COUNTS])),
    T.StructField("entities", T.StructType([
        T.StructField("urls", T.ArrayType(T.StructType([T.StructField("url", T.StringType())]))),
        T.StructField("user_mentions", T.ArrayType(T.StructType([T.StructField("screen_name", T.StringType())]))),
    ])),
    T.StructField("retweeted_status", T.StructType([
        T.StructField("id_str", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("user", T.StructType(_COUNTS)),
    ])),
])

KEYWORDS = "tid string, keyword struct<`0`:string,`1`:string>"

TRAINING = (
    "Topic boolean, Url boolean, Mention boolean, WordCount double, Capital double, Followers double, Statuses double, "
    "CharacterPerWord double, ellipsis boolean, RetweetCount double, RetweetLevel double, Personal boolean, Importance int"
)

HISTORY = "day string, pid int, tid string, score double"
