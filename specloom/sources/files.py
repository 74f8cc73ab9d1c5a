"""Documents in and out: JSON by file, blocks of text, delimited files, writes that skip what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from specloom.session import settled


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row per JSON file with ``slug``, its stem. The schema is stated: inference breaks unions and open maps."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("slug", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def split_union(value: Column) -> Column:
    """A number or an object of min and max (as VARIANT) as one struct: a number is both ends."""
    alone = F.try_variant_get(value, "$", "double")
    low, high = (F.coalesce(alone, F.try_variant_get(value, f"$.{k}", "double")) for k in ("min", "max"))
    return F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("min"), high.alias("max")))


def text_blocks(spark: SparkSession, path: str, separator: str = "\n== ") -> DataFrame:
    """The blocks of text files (path, pos, value); what comes before the first separator is no block."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    parts = F.slice(F.split(F.col("value"), f"\\Q{separator}\\E"), 2, F.size(F.split(F.col("value"), f"\\Q{separator}\\E")))
    return rows.select("path", F.posexplode(parts).alias("pos", "value"))


def decoded(spark: SparkSession, path: str, charset: str = "windows-1251") -> DataFrame:
    """(path, text) of files: UTF-8 if they are valid, else ``charset``."""
    rows = spark.read.format("binaryFile").load(path)
    other = F.pandas_udf(lambda column: column.map(lambda raw: bytes(raw).decode(charset, "replace")), "string")  # Spark decodes few charsets
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(other("content"))
    return rows.select("path", text.alias("text"))


def flagged(value: Column) -> Column:
    """True as a word, false and null as nothing."""
    return F.when(value, "ДА").otherwise("")


def joined(values: Column) -> Column:
    """An array in one cell; null is empty."""
    return F.coalesce(F.array_join(values, "; "), F.lit(""))


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """Delimited text with a header; every file begins with a byte-order mark, which rides on the first header name."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.option("sep", sep).option("header", True).option("encoding", "UTF-8").csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_new(df: DataFrame, path: str, key: str = "slug") -> DataFrame:
    """Appends the rows whose key the Parquet table at ``path`` lacks and returns them; ``tables.KeyedTable`` replaces rows too."""
    if exists(df.sparkSession, path):
        df = df.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    df = settled(df)  # what is appended must not be read again
    df.write.mode("append").parquet(path)
    return df


def replaced_between(text: Column, name: str, new: Column) -> Column:
    """``text`` with what stands between the markers of ``name`` replaced; the query fails without them."""
    start, stop = f"<!-- AUTO:{name} -->", f"<!-- /AUTO:{name} -->"
    head, tail = F.substring_index(text, start, 1), F.element_at(F.split(text, f"\\Q{stop}\\E", 2), -1)
    whole = F.concat(head, F.lit(start + "\n"), new, F.lit("\n" + stop), tail)
    return F.when(text.contains(start) & text.contains(stop), whole).otherwise(F.raise_error(F.lit(f"marker {name} is missing")))


def write_json_array(df: DataFrame, path: str, order: list[Column | str]) -> None:
    """The table as a JSON array, in ``order``: the files at ``path``, put together by name, are the array, a row a line.

    Rows are sorted by ranges, so no task has them all; brackets are rows of their own before and after.
    """
    spark = df.sparkSession
    bracket = lambda b: spark.range(0, 1, 1, 1).select(F.lit(b).alias("value"))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    comma = F.when(F.monotonically_increasing_id() == 0, " ").otherwise(",")  # the first row stands first in the first part
    body = rows.select(F.concat(comma, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value"))
    bracket("[").union(body).union(bracket("]")).write.mode("overwrite").text(path)


def write_sorted_json(df: DataFrame, path: str, key: str = "key") -> None:
    """One JSON object a line, in order of ``key`` over all files, keys of each object sorted, lines ended."""
    fields = sorted(c for c in df.columns)
    df.repartitionByRange(key).sortWithinPartitions(key).select(F.to_json(F.struct(*fields)).alias("value")).write.mode("overwrite").text(path)


def write_once(df: DataFrame, path: str) -> None:
    """Writes JSON; fails if there is anything at ``path``."""
    df.write.mode("errorifexists").json(path)


def in_field_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Columns in the stated order, those it does not name after them as they come."""
    return df.select(*[c for c in order if c in df.columns], *[c for c in df.columns if c not in order])


def write_listings_csv(df: DataFrame, path: str, names: dict[str, str], flag: str = "under_budget", error: str = "error") -> None:
    """``names`` (column to heading) of listings as CSV: the flag as a word, failed rows marked in its place."""
    mark = F.when(F.col(error).isNotNull(), "ОШИБКА").otherwise(flagged(F.col(flag)))
    write_csv(df.select(*[(mark if c == flag else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(h) for c, h in names.items()]), path)


def key_list(spark: SparkSession, path: str) -> DataFrame:
    """(slug): the words of text files, each once."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("slug")).where("slug <> ''").distinct()


def models_of(pages: DataFrame) -> DataFrame:
    """(url, pos, model_id, name) of brand pages (url, html): each model once, in page order."""
    link = r'(?s)model_(\d+)" class="brand-list-item--link">(.{0,900}?)参数'
    found = F.regexp_extract_all("html", F.lit(link), F.lit(0))
    name = lambda m: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(m, link, 2), "<[^>]+>", " "), r"(?U)\s+", " "))
    rows = F.array_distinct(F.transform(found, lambda m: F.struct(F.regexp_extract(m, link, 1).alias("model_id"), name(m).alias("name"))))
    return pages.select("url", F.posexplode(rows).alias("pos", "m")).select("url", "pos", "m.model_id", "m.name")


def trims_of(pages: DataFrame) -> DataFrame:
    """(url, pos, trim_id) of model pages: each trim once, in page order."""
    return pages.select("url", F.posexplode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"trim_(\d+)"), F.lit(1)))).alias("pos", "trim_id"))
