"""Explicit schemas of the stored tables and of the records passed between steps."""

from pyspark.sql import types as T


def _field(name: str, kind: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, kind, nullable)


FEEDS = T.StructType([
    _field("id", T.StringType()),
    _field("url", T.StringType()),
    _field("name", T.StringType()),
    _field("is_active", T.BooleanType()),
    _field("created_at", T.TimestampType()),
    _field("updated_at", T.TimestampType()),
])

ARTICLES = T.StructType([
    _field("id", T.StringType()),
    _field("feed_id", T.StringType()),
    _field("title", T.StringType()),
    _field("url", T.StringType()),
    _field("raw_content", T.StringType()),
    _field("summary", T.StringType()),
    _field("quality_score", T.IntegerType()),
    _field("published_at", T.TimestampType(), True),
    _field("created_at", T.TimestampType()),
])

EMBEDDINGS = T.StructType([
    _field("article_id", T.StringType()),
    _field("embedding", T.ArrayType(T.FloatType(), containsNull=False)),
    _field("created_at", T.TimestampType()),
])

# A re-dimensioned table also says which model made the vectors.
TAGGED_EMBEDDINGS = T.StructType([
    *EMBEDDINGS.fields[:2],
    _field("model", T.StringType()),
    EMBEDDINGS.fields[2],
])

RAW_FEEDS = T.StructType([
    _field("feed_id", T.StringType()),
    _field("fetched_at", T.TimestampType()),
    _field("body", T.StringType()),
])

ITEMS = T.StructType([
    _field("feed_id", T.StringType()),
    _field("item_pos", T.LongType()),
    _field("title", T.StringType(), True),
    _field("url", T.StringType(), True),
    _field("content", T.StringType(), True),
    _field("published_at", T.TimestampType(), True),
])

AI_RESULT = T.StructType([
    _field("three_line_summary", T.StringType(), True),
    _field("key_takeaways", T.ArrayType(T.StringType()), True),
    _field("quality_score", T.IntegerType(), True),
])

FEED_COLUMNS = FEEDS.fieldNames()
ARTICLE_COLUMNS = ARTICLES.fieldNames()

# Column limits of the stored tables, in characters, and the score range.
MAX_URL = 2048
MAX_FEED_NAME = 255
MAX_TITLE = 1024
MIN_SCORE = 1
MAX_SCORE = 10
EMBEDDING_DIM = 768
