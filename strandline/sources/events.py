"""Event sources: delimited files by schema, batch or streaming, parsed to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import model
from strandline.functions.text import int_set, optional_string
from strandline.functions.time import parse_zoned
from strandline.settings import Settings
from strandline.sources.topics import Topic


BAD = "_bad_line"


def _delimited(spark: SparkSession, path: str, ddl: str, separator: str, header: bool, streaming: bool, files_per_batch: int | None) -> DataFrame:
    options = {"sep": separator, "header": header, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "encoding": "UTF-8"}
    reader = (spark.readStream if streaming else spark.read).schema(f"{ddl}, {BAD} string").options(**options)
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    if streaming and "." in name:
        # A stream reads folders: a single file is the one of that name in its folder.
        return reader.option("pathGlobFilter", name).csv(folder)
    return reader.csv(path)


def delimited(spark: SparkSession, path: str, ddl: str, separator: str = "|", header: bool = True, streaming: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Rows of a delimited text file or folder under a schema; rows that don't fit are left out, not fatal: malformed() has them."""
    return _delimited(spark, path, ddl, separator, header, streaming, files_per_batch).where(F.col(BAD).isNull()).drop(BAD)


def malformed(spark: SparkSession, path: str, ddl: str, separator: str = "|", header: bool = True, streaming: bool = False) -> DataFrame:
    """(line): the lines that delimited() leaves out, for a sink of errors."""
    rows = _delimited(spark, path, ddl, separator, header, streaming, None)
    # A query of the bad lines alone is refused: the other columns must be read with them.
    others = F.to_csv(F.struct(*[c for c in rows.columns if c != BAD]))
    return rows.where(F.col(BAD).isNotNull()).select(F.coalesce(F.col(BAD), others).alias("line"))


def lines(spark: SparkSession, path: str, parse, streaming: bool = False) -> DataFrame:
    """The rows that a parser of one's own makes of a text file's lines: a function from the line's column to one of a struct, null for a line that is none."""
    text = (spark.readStream if streaming else spark.read).text(path)
    return text.select(parse(F.col("value")).alias("row")).where("row is not null").select("row.*")


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", parse_zoned(F.col("creation_date"))).where("ts is not null").drop("creation_date")


def likes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return _timed(delimited(spark, path, model.LIKE, streaming=streaming))


def posts(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    df = _timed(delimited(spark, path, model.POST, streaming=streaming))
    texts = {c: optional_string(F.col(c)) for c in ("image_file", "location_ip", "browser", "language", "content")}
    return df.withColumns(texts | {"tags": int_set(F.col("tags"))})


def raw_comments(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    df = _timed(delimited(spark, path, model.COMMENT, streaming=streaming))
    return df.withColumns({c: optional_string(F.col(c)) for c in ("location_ip", "browser", "content")})


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b): the first two columns of a relation's file."""
    return delimited(spark, path, model.PAIR)


def forum_titles(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, model.FORUM)


def as_events(posts: DataFrame, comments: DataFrame, likes: DataFrame) -> DataFrame:
    """One stream of (event_type, post_id, person_id, ts): a comment that names another comment is a reply. comments must have their post_id."""
    kind = F.when(F.col("reply_to_comment_id").isNotNull(), "Reply").otherwise("Comment")
    columns = ["event_type", "post_id", "person_id", "ts"]
    return (
        posts.withColumn("event_type", F.lit("Post")).select(columns)
        .unionByName(comments.withColumn("event_type", kind).select(columns))
        .unionByName(likes.withColumn("event_type", F.lit("Like")).select(columns))
    )


def bounded(events: DataFrame, out_of_orderness: str = "30 minutes") -> DataFrame:
    """events with a watermark so far behind the newest time."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", out_of_orderness)


class Sources:
    """Streams of each kind: from the topic of its name if a group of readers is given, from its file in a folder if not; with the settings' watermark.

    Files are likes.csv, posts.csv and comments.csv; topics hold their typed rows. A Kafka source is a function of a topic's name and schema that gives a stream.
    """

    def __init__(self, spark: SparkSession, settings: Settings, files: str | None = None, topics: str | None = None, group: str | None = None, kafka=None):
        self.spark, self.settings, self.files, self.topics, self.group, self.kafka = spark, settings, files, topics, group, kafka

    def _topic(self, name: str, schema: str) -> DataFrame:
        if self.kafka:
            return self.kafka(name, schema, self.group)
        if not self.topics:
            raise ValueError(f"there is no folder of topics to read {name} from")
        return Topic(self.spark, self.topics, name, schema).stream()

    def _one(self, name: str, reader, schema: str) -> DataFrame:
        if self.group:
            rows = self._topic(name, schema)
        elif self.files:
            rows = reader(self.spark, f"{self.files.rstrip('/')}/{name}.csv", streaming=True)
        else:
            raise ValueError("there must be a folder of files, or a group to read topics for")
        return bounded(rows, self.settings.max_out_of_orderness)

    def likes(self) -> DataFrame:
        return self._one("likes", likes, "person_id long, post_id long, ts timestamp")

    def posts(self) -> DataFrame:
        return self._one("posts", posts, TYPED_POST)

    def raw_comments(self) -> DataFrame:
        return self._one("comments", raw_comments, TYPED_COMMENT)

    def comments(self) -> DataFrame:
        """Comments with their posts, as the job of reply trees writes them to its topic."""
        return bounded(self._topic("resolved", RESOLVED), self.settings.max_out_of_orderness)

    def post_statistics(self) -> DataFrame:
        return self._topic("statistics", model.STATISTICS)


TYPED_POST = model.POST.replace("creation_date string, ", "").replace("tags string", "tags array<int>") + ", ts timestamp"
TYPED_COMMENT = model.COMMENT.replace("creation_date string, ", "") + ", ts timestamp"
RESOLVED = "comment_id long, post_id long, person_id long, reply_to_comment_id long, ts timestamp"
