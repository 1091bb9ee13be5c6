"""Readers and parsers of price files."""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (";", ",", "\t")


def sniff_delimiter(spark: SparkSession, path: str, lines: int = 5, least: int = 3) -> str | None:
    """The delimiter that each of the first lines has most and at least `least` times."""
    first = [r["value"] for r in spark.read.text(path).limit(lines).collect()]
    counts = {d: min((line.count(d) for line in first), default=0) for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: counts[d])
    return best if counts[best] >= least else None


def bars_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Date timestamp, open double, high double, low double, close double, n_bars long").option("timestampFormat", "yyyy-MM-dd[ HH:mm:ss]").csv(path, header=True)


def parse_minutes(lines: DataFrame, line: str = "value") -> DataFrame:
    """ts, open, high, low, close, volume of minute lines of several layouts.

    Layouts: `YYYYMMDD HHMMSS;o;h;l;c;v`, `date,time,o,h,l,c,v`, and
    `ticker,YYYYMMDD,HHMMSS,o,h,l,c,v`.  Lines without a valid time or prices,
    and bars with low > min(open, close) or high < max(open, close), go.
    """
    parts = F.split(F.col(line), r"[;,\t]")
    n, get = F.size(parts), lambda i: F.get(parts, i)
    first = F.when(get(0).rlike(r"^[0-9]"), 0).otherwise(1)
    joined = get(0).rlike(r"^[0-9]{8} [0-9]{6}$")
    digits = lambda c: F.regexp_replace(c, r"[^0-9]", "")
    clock = F.rpad(digits(F.when(joined, F.substring(get(0), 10, 6)).otherwise(F.get(parts, first + 1))), 6, "0")
    date = digits(F.when(joined, F.substring(get(0), 1, 8)).otherwise(F.get(parts, first)))
    at = F.when(joined, 1).otherwise(first + 2)
    price = lambda k: F.get(parts, at + k).try_cast("double")
    rows = lines.where(n >= 5).select(
        F.try_to_timestamp(F.concat(date, clock), F.lit("yyyyMMddHHmmss")).alias("ts"),
        price(0).alias("open"), price(1).alias("high"), price(2).alias("low"), price(3).alias("close"), F.coalesce(price(4), F.lit(0.0)).alias("volume"),
    )
    good = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return rows.where(F.col("ts").isNotNull() & good)


def to_utc(ts: Column, zone: str = "America/New_York") -> Column:
    """Local wall time to UTC; null where the wall time is skipped or occurs twice."""
    utc = F.to_utc_timestamp(ts, zone)
    skipped = F.from_utc_timestamp(utc, zone) != ts
    twice = (F.from_utc_timestamp(utc - F.expr("interval 1 hour"), zone) == ts) | (F.from_utc_timestamp(utc + F.expr("interval 1 hour"), zone) == ts)
    return F.when(~skipped & ~twice, utc)


def minute_records(spark: SparkSession, path: str, scale: float = 1e5) -> DataFrame:
    """path, offset, open, close, low, high, volume of LZMA files of binary minutes.

    A record is five big-endian integers (second of the day, open, close, low,
    high in points) and a float (volume).  Minutes without volume go.
    """

    def decode(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        record = struct.Struct(">5If")
        for batch in files:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                raw = lzma.decompress(content) if content else b""
                rows = [r for r in record.iter_unpack(raw[: len(raw) - len(raw) % record.size]) if r[5] > 0]
                yield pd.DataFrame(
                    [(path, r[0], r[1] / scale, r[2] / scale, r[3] / scale, r[4] / scale, r[5]) for r in rows],
                    columns=["path", "offset", "open", "close", "low", "high", "volume"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, offset long, open double, close double, low double, high double, volume double")


def chart_rows(payload: DataFrame, column: str = "json") -> DataFrame:
    """ts, open, high, low, close of a columnar chart answer; incomplete rows and empty answers go."""
    schema = "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>>>>>>>"
    one = F.get(F.from_json(column, schema)["chart"]["result"], F.lit(0))
    quote = F.get(one["indicators"]["quote"], F.lit(0))
    rows = payload.select(F.explode(F.arrays_zip(one["timestamp"].alias("t"), quote["open"].alias("o"), quote["high"].alias("h"), quote["low"].alias("l"), quote["close"].alias("c"))).alias("x"))
    return rows.select(F.timestamp_seconds("x.t").alias("ts"), F.col("x.o").alias("open"), F.col("x.h").alias("high"), F.col("x.l").alias("low"), F.col("x.c").alias("close")).dropna()


def observation_csv(spark: SparkSession, path: str) -> DataFrame:
    """DATE, value of a statistics office's CSV, where a dot means missing."""
    return spark.read.csv(path, header=True).toDF("DATE", "value").select(F.to_date("DATE").alias("DATE"), F.col("value").try_cast("double").alias("value")).dropna()


def split_quote(big: Column, small: Column) -> Column:
    """A quote whose big figure and pips come apart."""
    return F.concat(big, small).try_cast("double")


def live_quotes(lines: DataFrame, line: str = "value") -> DataFrame:
    """pair, ts, bid, ask, mid of lines of nine fields: pair, milliseconds, and
    the big figure and pips of bid and ask; lines without them go."""
    part = F.split(F.trim(line), ",")
    get = lambda i: F.get(part, F.lit(i))
    rows = lines.where(F.size(part) == 9).select(
        get(0).alias("pair"), F.timestamp_millis(get(1).try_cast("bigint")).alias("ts"), split_quote(get(2), get(3)).alias("bid"), split_quote(get(4), get(5)).alias("ask")
    )
    return rows.dropna().withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


def text_corpus(spark: SparkSession, path: str, least: int = 500) -> DataFrame:
    """name, text of whole text files of more than `least` characters; space at the ends goes."""
    rows = spark.read.text(path, wholetext=True).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1))
    return long_enough(rows.withColumnRenamed("value", "text"), least).select("name", "text")


def long_enough(texts: DataFrame, least: int = 500) -> DataFrame:
    return texts.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where(F.length("text") > least)


def article_text(html: Column, least: int = 500) -> Column:
    """The text of a page's article without scripts, styles, navigation and
    figures; entities decoded, space collapsed; null if shorter than `least`."""
    inner = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.when(F.length(inner) > 0, inner).otherwise(html)
    body = F.regexp_replace(body, r"(?is)<(script|style|nav|figure)[^>]*>.*?</(script|style|nav|figure)>", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    body = F.trim(F.regexp_replace(body, r"[ \t\r\n\f]+", " "))
    return F.when(F.length(body) >= least, body)
