"""Readers and writers for the study's own file formats (topic JSON, result CSV, JSONL).

These are plain Spark sources with declared schemas (no inference):
topic files are multi-line JSON objects whose slug is the lower-cased
file stem; result CSVs are accepted only when they carry the stance-count
columns; outputs are written with the DataFrame writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

TOPIC_SCHEMA = ("question string, pros array<string>, cons array<string>, sources map<string,string>, "
                "paraphrases array<struct<question:string,orientation:string>>")
COUNTS_SCHEMA = "issue string, issue_stance string, count long, case string, model string"


def read_topics(spark: SparkSession, folder: str) -> DataFrame:
    """One row per topic file (``*.json``), whatever its question; ``slug`` = lower-cased file stem."""
    t = (spark.read.schema(TOPIC_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json")
         .json(folder).withColumn("file_name", F.col("_metadata.file_name")))
    t = t.withColumn("slug", F.lower(F.regexp_replace("file_name", r"\.json$", "")))
    return t


def question_map(topics: DataFrame) -> DataFrame:
    """(question_key, slug, orientation) of every paraphrase; of files with the same one the last name wins."""
    p = paraphrases(topics).filter(F.col("question_key").isNotNull())
    best = p.groupBy("question_key").agg(F.max(F.struct("file_name", "paraphrase_idx", "slug", "orientation")).alias("b"))
    return best.select("question_key", "b.slug", F.coalesce("b.orientation", F.lit("")).alias("orientation"))


def paraphrases(topics: DataFrame) -> DataFrame:
    """(slug, paraphrase_idx, question, orientation), plus the lower/strip lookup key."""
    p = topics.select("slug", "file_name", F.posexplode("paraphrases").alias("paraphrase_idx", "p"))
    return p.select("slug", "file_name", "paraphrase_idx", F.col("p.question").alias("question"),
                    F.lower(F.trim(F.col("p.orientation"))).alias("orientation"),
                    F.lower(F.trim(F.col("p.question"))).alias("question_key"))


def arguments(topics: DataFrame) -> DataFrame:
    """(slug, side, idx, text) from the pros and cons arrays."""
    pros = topics.select("slug", F.lit("pro").alias("side"), F.posexplode("pros").alias("idx", "text"))
    cons = topics.select("slug", F.lit("con").alias("side"), F.posexplode("cons").alias("idx", "text"))
    return pros.unionByName(cons)


def thin_topics(topics: DataFrame, min_args: int = 3) -> DataFrame:
    """Topics with fewer than ``min_args`` arguments on a side (or a missing side)."""
    s = topics.select("slug", F.size(F.coalesce("pros", F.array())).alias("pro"),
                      F.size(F.coalesce("cons", F.array())).alias("con"))
    long = s.selectExpr("slug", "stack(2, 'pros', pro, 'cons', con) AS (side, n)")
    return long.filter(F.col("n") < min_args)


def csv_fields(line: Column) -> Column:
    """The fields of one CSV line: split at commas outside quotes, quotes taken off and doubled ones halved."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*)'), 1)
    return F.transform(raw, lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(
        F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def read_by_header(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The columns of ``schema`` from all CSV files of ``folder`` that have them, each by its file's own header.

    Files may order their columns in any way and hold others; files that lack one are left out.  Values that don't
    fit the type are null.  The header of a file (its first line that isn't blank) meets the file's lines in a join
    on the path (two scans, whatever the number of files); no header reaches the driver.  A header line
    itself stays, as a row of its names (null where a type is not string); repeated names count once, the first.
    Values hold no line ends."""
    wanted = T.StructType.fromDDL(schema)
    lines = spark.read.text(folder, pathGlobFilter="*.csv").where(F.trim("value") != "").select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    heads = lines.groupBy("path").agg(F.min_by("line", F.struct("start", "id")).alias("head"))
    names = F.transform(csv_fields(F.col("head")), lambda name: F.trim(name))
    places = heads.select("path", F.transform(F.array(*[F.lit(f.name) for f in wanted]),
                                              lambda name: F.array_position(names, name).cast("int")).alias("places"))
    places = places.where(~F.exists("places", lambda x: x == 0))
    fields = lines.join(places, "path").select("places", csv_fields(F.col("line")).alias("fields"))
    return fields.select(*[F.try_element_at("fields", F.nullif(F.col("places")[i], F.lit(0))).try_cast(f.dataType).alias(f.name)
                           for i, f in enumerate(wanted)])


def read_stance_csvs(spark: SparkSession, folder: str) -> DataFrame:
    """Result CSVs of a folder that carry (issue, issue_stance, count, case, model), in any column order
    and beside other columns; other CSVs are left out.  The model name loses ``.csv``; rows without a count go."""
    out = read_by_header(spark, folder, COUNTS_SCHEMA)
    return out.filter((F.col("issue") != "") & F.col("count").isNotNull()).withColumn(
        "model", F.regexp_replace("model", r"\.csv", "")).withColumnRenamed("case", "ecase")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sort_by: list[str] | None = None) -> None:
    """Overwrite a result table (Parquet by default; CSV with header, or JSON lines),
    optionally globally sorted by ``sort_by`` (range-partitioned sort, as before a keyed write)."""
    if sort_by:
        df = df.orderBy(*sort_by)
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the lines of all text files under ``path``, numbered from 0 by file name and place.

    A line's number is its place within its split plus the lines of the splits before it; only the splits' counts
    are summed up in order, so files of any size and number are read in parallel."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    split = ["_file", "_start"]
    counts = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per split
    inside = F.row_number().over(W.partitionBy(*split).orderBy("_id")) - 1
    return lines.withColumn("_at", inside).join(counts.select(*split, before.alias("_before")), split).select((F.col("_before") + F.col("_at")).alias("line_no"), "value")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, url, position) of the URLs listed under ``path``, one a line; blank lines are passed over, and
    position counts the URLs from 0, so "the first five" are those with a position below 5."""
    found = read_lines(spark, path).select("line_no", F.trim("value").alias("url")).where("url <> ''")
    # positions in ranges of a thousand lines, so no task orders the whole list
    ranged = found.withColumn("_range", F.floor(F.col("line_no") / 1000))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per thousand lines
    inside = F.row_number().over(W.partitionBy("_range").orderBy("line_no")) - 1
    return ranged.withColumn("_in", inside).join(counts.select("_range", before.alias("_before")), "_range").select(
        "line_no", "url", (F.col("_before") + F.col("_in")).alias("position"))
