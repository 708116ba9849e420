"""The posts data model: columns, types, tag categories and ratings."""

from __future__ import annotations

from pyspark.sql import types as T

LONG_COLUMNS = ("id", "score", "fav_count", "file_size", "image_width", "image_height")

#: The columns of a post, in order.
COLUMNS = (
    "id", "rating", "score", "fav_count", "file_url",
    "tag_string_artist", "tag_string_copyright", "tag_string_character", "tag_string_general", "tag_string_meta",
    "file_size", "image_width", "image_height", "created_at", "md5", "tag_string",
)

POSTS_SCHEMA = T.StructType([T.StructField(c, T.LongType() if c in LONG_COLUMNS else T.StringType()) for c in COLUMNS])

#: Tag categories in order of priority, and the names of ratings.
CATEGORIES = ("artist", "copyright", "character", "general", "meta")
RATINGS = {"g": "General", "s": "Sensitive", "q": "Questionable", "e": "Explicit"}

MIXED, UNKNOWN = "mixed", "unknown"
#: The colour of each category's tags, and of tags of no category.
COLORS = {"artist": "#f38ba8", "copyright": "#cba6f7", "character": "#a6e3a1", "general": "#89b4fa", "meta": "#fab387"}
NO_COLOR = "#cdd6f4"


def column_of(category: str) -> str:
    """The column that holds a category's tags."""
    if category not in CATEGORIES:
        raise ValueError(f"unknown tag category: {category}")
    return f"tag_string_{category}"
