"""Marked-up news records, many per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The record tag and the attribute values of the file format.
RECORD_TAG = "REUTERS"
TRAINING_MARK = "TRAINING-SET"
WITH_TOPICS = "YES"

# A code point that is never text; holds the place of a genuine U+FFFD.
_STAND_IN = "﷐"


def scrub(raw: Column) -> Column:
    """Remove undecodable bytes and one- or two-digit character references, and all that stands
    before the record."""
    genuine = F.replace(raw, F.lit("�"), F.lit(_STAND_IN))
    valid = F.replace(F.make_valid_utf8(genuine), F.lit("�"), F.lit(""))
    valid = F.replace(valid, F.lit(_STAND_IN), F.lit("�"))
    valid = F.regexp_replace(valid, r"&#\d{1,2};", "")
    return F.regexp_extract(valid, f"(?s)(<{RECORD_TAG}.*)$", 1)


def derive_split(mark: Column) -> Column:
    """``train`` for the training mark, ``test`` for everything else, null included."""
    return F.when(mark == TRAINING_MARK, "train").otherwise("test")


def read_sgml(
    spark: SparkSession,
    path: str,
    everything: bool = True,
    glob: str = "*sgm",
    mode: str = "FAILFAST",
) -> DataFrame:
    """(doc_id, text, topics, split) from all files of a folder that match ``glob``.

    The closing tag is the line separator, so large files are split and each row is
    one record, parsed once. The text is the body, else the text that leads the
    text element, else empty. ``everything=False`` keeps only records marked as
    having topics. A record that cannot be parsed fails the read; in ``mode`` ``PERMISSIVE`` it is a row
    without id, text or topics, so bad records can be counted.
    """
    end = f"</{RECORD_TAG}>"
    lines = spark.read.option("lineSep", end).option("pathGlobFilter", glob).text(path)
    records = lines.select(scrub(F.col("value")).alias("record")).filter(F.col("record") != "")
    schema = (
        "_NEWID string, _TOPICS string, _CGISPLIT string, "
        "TOPICS struct<D: array<string>>, TEXT struct<BODY: string>, _bad string"
    )
    options = {
        "rowTag": RECORD_TAG,
        "ignoreSurroundingSpaces": "false",
        "nullValue": "\u0000",
        "mode": mode,
        "columnNameOfCorruptRecord": "_bad",
    }
    parsed = records.select(
        "record",
        F.from_xml(F.concat("record", F.lit(end)), schema, options).alias("r"),
    )
    if not everything:
        parsed = parsed.filter(F.col("r._TOPICS") == WITH_TOPICS)
    # Evaluated only for the records that were parsed and have no body.
    bodiless = F.col("r.TEXT.BODY").isNull() & F.col("r._bad").isNull()
    leading = F.xpath_string(
        F.concat("record", F.lit(end)), F.lit(f"/{RECORD_TAG}/TEXT/node()[1][self::text()]")
    )
    return parsed.select(
        F.col("r._NEWID").cast("long").alias("doc_id"),
        F.coalesce(
            F.when(bodiless, leading).otherwise(F.col("r.TEXT.BODY")), F.lit("")
        ).alias("text"),
        F.coalesce(F.col("r.TOPICS.D"), F.array().cast("array<string>")).alias("topics"),
        derive_split(F.col("r._CGISPLIT")).alias("split"),
    )
