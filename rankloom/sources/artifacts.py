"""Reading and writing the artifacts of a run: JSON lines, CSV, file manifests, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: StructType | str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines.  Blank lines are skipped; lines that are no object of the schema are skipped, or an error if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(paths)


def read_shards(spark: SparkSession, directory: str, glob: str, schema: StructType | str) -> DataFrame:
    """All shards of a directory as one table, with shard: the file's name, by which they are ordered."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").json(directory)
    return rows.withColumn("shard", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def count_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(n): lines that are not blank."""
    return spark.read.text(paths).filter(F.trim("value") != "").agg(F.count("*").alias("n"))


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def read_files(spark: SparkSession, directory: str, glob: str = "*", most: int | None = None) -> DataFrame:
    """(path, size, sha256) of the files below a directory, by path; at most ``most``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(directory)
    out = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("path")
    return out.limit(most) if most else out


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) of every file of the manifest that is missing, differs, or has a path that leaves its folder."""
    both = manifest.select("path", F.col("sha256").alias("wanted")).join(files.select("path", "sha256"), "path", "left")
    unsafe = F.col("path").rlike("(^|/)\\.\\.(/|$)")
    problem = F.when(unsafe, "unsafe").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("wanted"), "differs")
    return both.select("path", problem.alias("problem")).filter("problem is not null")


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One file a partition; without ``append`` what was there is replaced when the job commits."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, separator: str = ", ") -> None:
    """With a header; arrays become one joined text."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), separator).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace all rows of the keys that ``df`` has, and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def verify_written(written: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many keys were expected, are missing, and are there without being expected."""
    a, b = expected.select(*key).distinct().withColumn("_a", F.lit(1)), written.select(*key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count("_a").alias("expected"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("unexpected"))


def inverted_index_text(index: Column) -> Column:
    """The text of a map from word to positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("at"), e.key.alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p.word), " ")


def outline_rows(spark: SparkSession, outline: DataFrame, doc: str, children: str, deepest: int = 8) -> DataFrame:
    """(doc, level, path, title, page) of a nested outline, level by level; ``children`` is JSON: [{title, page, children}]."""
    item = "array<struct<title:string,page:int,children:string>>"
    level = outline.select(doc, F.col(children).alias("_json"), F.array().cast("array<int>").alias("path"))
    out = None
    for depth in range(1, deepest + 1):
        here = level.select(doc, "path", F.posexplode(F.from_json("_json", item)).alias("_at", "_item"))
        rows = here.select(doc, F.lit(depth).alias("level"), F.concat("path", F.array("_at")).alias("path"), "_item.title", "_item.page", F.col("_item.children").alias("_json"))
        out = rows.drop("_json") if out is None else out.unionByName(rows.drop("_json"))
        level = rows.select(doc, "_json", "path").filter("_json is not null")
    return out


def read_themes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, title, description) of Markdown themes: the first line that is not blank, and the paragraphs after it, or the title where there are none."""
    said = F.col("value")
    title = F.regexp_extract(said, "(?m)^\\s*(\\S.*?)\\s*$", 1)
    paragraphs = F.filter(F.transform(F.split(F.regexp_replace(said, "\r\n?", "\n"), "\n\n"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")
    body = F.array_join(paragraphs, "\n\n")
    rest = F.when(F.startswith(body, title), F.regexp_replace(F.substr(body, F.length(title) + 1), "^\\s+|\\s+$", "")).otherwise(body)
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), title.alias("title"), rest.alias("description"))
    return rows.withColumn("description", F.when(F.col("description") == "", F.col("title")).otherwise(F.col("description")))


def xml_summary(xml: Column, most: int = 15) -> Column:
    """(status, title, heads, preview, has_abstract, has_bibliography) of a structured text in XML, by element names."""
    heads = F.filter(F.transform(F.xpath(xml, F.lit("//head//text()")), lambda t: F.trim(t)), lambda t: t != "")
    has = lambda name: F.xpath_boolean(xml, F.lit(f"boolean(//{name})"))
    full = F.struct(F.lit("ok").alias("status"), F.nullif(F.trim(F.xpath_string(xml, F.lit("//title"))), F.lit("")).alias("title"), F.size(heads).alias("heads"), F.slice(heads, 1, most).alias("preview"), has("abstract").alias("has_abstract"), has("listBibl").alias("has_bibliography"))
    empty = F.struct(F.lit("empty").alias("status"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("heads"), F.array().cast("array<string>").alias("preview"), F.lit(False).alias("has_abstract"), F.lit(False).alias("has_bibliography"))
    return F.when(F.coalesce(xml, F.lit("")) == "", empty).otherwise(full)


def read_suite(spark: SparkSession, root: str, manifest: str) -> dict[str, DataFrame]:
    """chapters, documents and judgments that a suite's manifest lists by relative path, one row a file."""
    listed = spark.read.option("multiLine", "true").json(f"{root}/{manifest}").first().asDict()
    paths = {name: [f"{root}/{p}" for p in listed.get(column) or []] for name, column in (("chapters", "chapter_specs"), ("documents", "documents"), ("judgments", "judgments"))}
    return {name: spark.read.option("multiLine", "true").json(found) for name, found in paths.items() if found}
