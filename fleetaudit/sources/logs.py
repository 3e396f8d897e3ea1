"""Log lines and event payloads as exported by collectors."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.stage import staged

# A line starts with its time, then the process, then the message.
_LINE = r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(\S+)\s+(.*)$"


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(pieces), lambda x: x["text"]), "\n")


def read_log_text(spark: SparkSession, glob: str, instance_from: str = r"instance=([^/]+)") -> DataFrame:
    """Error logs as plain text files; the instance comes from the file's path.

    An entry starts with its time; lines without one, blank ones too, continue the entry before them. Nothing is
    dropped: lines before a file's first entry come as rows of their own, they and entries whose
    time is no date with a null time, and ``rejected`` marks them.

    A long file is read by many tasks. Each split numbers its entries by counting the starts in it. The lines
    at its head, before its first start, belong to the last entry of the nearest split before it that
    has one, which a sum over the splits of a file finds: one row per split, not per line. The lines are written
    once, so that all readings see the same splits; besides an entry itself nothing is gathered.
    """
    lines = (spark.read.text(glob)
             .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
             .withColumn("starts", F.col("value").rlike(_LINE)))
    along = Window.partitionBy("path", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = staged(lines.withColumn("entry", F.sum(F.col("starts").cast("int")).over(along)).drop("starts"), "log-lines")

    piece = F.struct("split", "line", F.col("value").alias("text"))
    own = lines.where("entry > 0").groupBy("path", "split", "entry").agg(_joined(F.collect_list(piece)).alias("value"))
    # The entry that is open where a split begins.
    splits = lines.groupBy("path", "split").agg(F.max("entry").alias("entries"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("entries") > 0, F.struct(F.col("split"), F.col("entries").alias("entry")))
    opened = splits.select("path", "split", F.last(last, ignorenulls=True).over(before).alias("open"))
    heads = lines.where("entry = 0").drop("entry").join(opened, ["path", "split"])
    more = (heads.where(F.col("open").isNotNull()).groupBy("path", F.col("open.split").alias("split"), F.col("open.entry").alias("entry"))
            .agg(_joined(F.collect_list(piece)).alias("more")))
    entries = own.join(more, ["path", "split", "entry"], "left").select("path", F.concat_ws("\n", "value", "more").alias("value"))
    loose = heads.where(F.col("open").isNull()).select("path", "value").where(F.trim("value") != "")
    entries = entries.unionByName(loose)

    first = F.regexp_extract("value", _LINE, 1)
    at = F.expr(f"try_to_timestamp(nullif(regexp_extract(value, r'{_LINE}', 1), ''))").cast("timestamp_ntz")
    return entries.select(F.regexp_extract("path", instance_from, 1).alias("instance_id"), at.alias("log_date"),
                          F.when(first != "", F.regexp_extract("value", _LINE, 2)).alias("process_info"),
                          F.when(first != "", F.rtrim(F.regexp_extract("value", _LINE, 3))).otherwise(F.col("value")).alias("message"),
                          at.isNull().alias("rejected"))


_OPEN = r"<event(?=[\s/>])"
_EMPTY = r"(?s)^<event\b[^<>]*/>"  # an event that is closed in its own tag
# What every event has; ``_broken`` holds the payload that the parser can not read.
_EVENT = "_name string, _timestamp string, _broken string"


def read_event_payloads(spark: SparkSession, glob: str, instance_from: str = r"instance=([^/]+)") -> DataFrame:
    """Event files by wildcard path: XML events of any shape, one a line, several a line or over many lines.

    Files are cut at the closing tag of an event, so that a long file is read by many tasks. Each event keeps its text and
    is named by its ``name`` attribute. The XML parser reads it with a declared schema and a column for what is
    broken: an event cut short, closed badly or without a name is kept, with ``rejected`` set and the name where its opening tag has one.
    """
    records = spark.read.option("lineSep", "</event>").text(glob).select(F.col("_metadata.file_path").alias("path"), "value")
    # Before the first opening tag there is white space or the end of a list; of several events in one record only the last was closed by its end.
    parts = F.slice(F.split("value", f"(?={_OPEN})"), 1, 1 << 30)
    events = records.where(F.col("value").contains("<event")).select("path", F.posexplode(parts).alias("n", "part"), F.size(parts).alias("of"))
    events = events.where(F.col("part").rlike("^" + _OPEN))
    empty, closed = F.regexp_extract("part", _EMPTY, 0), F.col("n") == F.col("of") - 1
    payload = F.when(empty != "", empty).when(closed, F.concat("part", F.lit("</event>"))).otherwise(F.rtrim(F.regexp_replace("part", r"\s+$", "")))
    events = events.select("path", payload.alias("event_data"), ((empty != "") | closed).alias("whole"))
    read = F.from_xml("event_data", _EVENT, {"rowTag": "event", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    events = events.withColumn("e", F.when(F.col("whole"), read))
    tag = F.regexp_extract("event_data", r"^<event\b[^<>]*?\bname=[\"']([^\"']*)[\"']", 1)
    good = F.col("whole") & F.col("e._broken").isNull() & F.coalesce(F.col("e._name") != "", F.lit(False))
    return events.select(F.regexp_extract("path", instance_from, 1).alias("instance_id"), F.coalesce("e._name", tag).alias("object_name"), "event_data",
                         (~F.coalesce(good, F.lit(False))).alias("rejected"))
