"""Schemas of events, tables and documents."""

from __future__ import annotations

from pyspark.sql import types as T

LIKE = "person_id long, post_id long, creation_date string"
POST = "post_id long, person_id long, creation_date string, image_file string, location_ip string, browser string, language string, content string, tags string, forum_id long, place_id int"
COMMENT = "comment_id long, person_id long, creation_date string, location_ip string, browser string, content string, reply_to_post_id long, reply_to_comment_id long, place_id int"
PAIR = "a long, b long"
FORUM = "forum_id long, title string, created string"
EVENT = "event_type string, post_id long, person_id long, ts timestamp"
STATISTICS = "post_id long, window_end timestamp, comment_count long, reply_count long, like_count long, distinct_users long, new_post boolean"
VECTOR = "person_id long, event_type string, event_id long, ts timestamp, features array<double>"
CLUSTER = "index int, centroid array<double>, weight double, label string"
PREFIX = {"tag": "T", "work": "W", "study": "S"}


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
