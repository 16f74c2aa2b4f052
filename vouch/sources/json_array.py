"""JSON arrays of any size in one file, read by as many tasks as the file has blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vouch.operators.lineage import cut

#: Text up to a brace that is not part of a string, in front of the brace.
_TO_BRACE = r'[^"{]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"{]*+)*+'


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _before(df: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all earlier pieces of the file. A window adds inside a
    block, and the totals of the earlier blocks (one row a block) are joined."""
    block = Window.partitionBy("file", "block").orderBy("id")
    inside = df.withColumn("_in", F.sum(value).over(block) - F.col(value))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("file", "block").agg(F.sum(value).alias("_t")).select(
        "file", "block", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_early"))
    return inside.join(totals, ["file", "block"]).withColumn(
        out, F.col("_in") + F.col("_early")).drop("_in", "_early")


def json_texts(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """The text of every object that lies in ``level`` other objects (column ``json``).

    The file is cut at closing braces, which Spark's text reader does by byte ranges, so a file
    without line breaks is also dealt to several tasks. Whether a piece starts inside a string, how
    deep it lies and to which object it belongs are sums over the earlier pieces: inside a block by
    a window, over the blocks by their totals. The pieces of an object are put together by one
    grouping. Braces and escaped quotes inside strings are no borders. An array at the top has
    level 0; ``{"results": {"bindings": [...]}}`` has level 2. Whatever surrounds the objects (a
    byte-order mark, brackets, commas, other members) is left out; an empty array gives no row. The
    text must be JSON; an object that the file breaks off in is left out.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("piece"))
    bare = F.regexp_replace("piece", r"(?s)\\.", "")
    df = _before(cut(raw).withColumn("quotes", _count(bare, '"')), "quotes", "_q")
    inside = F.col("_q") % 2 == 1
    opened = F.when(inside, '"').otherwise("")
    outside = F.regexp_replace(F.concat(opened, bare), '"[^"]*+(?:"|$)', "")
    closes = (F.col("_q") + F.col("quotes")) % 2 == 0
    df = df.select("file", "block", "id", "piece", opened.alias("opened"), closes.alias("closes"),
                   _count(outside, "{").alias("opens"))
    df = df.withColumn("change", F.col("opens") - F.col("closes").cast("int"))
    df = _before(df, "change", "depth")
    df = df.withColumn("ends", (F.col("closes") & (F.col("depth") + F.col("change") == level)
                                & (F.col("depth") + F.col("opens") > level)).cast("int"))
    df = _before(df, "ends", "number")
    # the object starts at the brace that goes one deeper than the level
    starts = (F.col("depth") <= level) & (F.col("depth") + F.col("opens") > level)
    skip = F.concat(F.lit(f"(?s)^(?:{_TO_BRACE}\\{{){{"), (level - F.col("depth")).cast("string"),
                    F.lit(f"}}{_TO_BRACE}(?=\\{{)"))
    text = F.when(starts, F.regexp_replace(F.concat("opened", "piece"), skip, F.lit(""))).otherwise(
        F.col("piece"))
    parts = df.where(starts | (F.col("depth") > level)).select(
        "file", "number", "ends", F.struct("block", "id", F.concat(text, F.lit("}")).alias("text")).alias("p"))
    whole = parts.groupBy("file", "number").agg(F.array_sort(F.collect_list("p")).alias("ps"),
                                                F.max("ends").alias("ended"))
    return whole.where("ended = 1").select(F.concat_ws("", F.col("ps.text")).alias("json"))


def read_json_array(spark: SparkSession, path: str, schema, level: int = 0) -> DataFrame:
    """The objects of JSON arrays as rows of ``schema``; see ``json_texts``."""
    return json_texts(spark, path, level).select(F.from_json("json", schema).alias("r")).select("r.*")
