"""Loading documents and their configuration as DataFrames.

docs: sop_id, title, department, department_name, version, language, owner,
effective_date, next_review, status, parent_id, frontmatter (map), body, full_text,
path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: File stems that are no documents.
SKIPPED = ("readme", "contributing", "license", "changelog", "notes", "index")
_FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, stem, raw of every Markdown file but the skipped ones."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    rows = files.select(F.col("_metadata.file_path").alias("path"), stem.alias("stem"), F.col("value").alias("raw"))
    return rows.filter(~F.lower("stem").isin(*SKIPPED) & ~F.col("stem").rlike(r"^[._]"))


def frontmatter(raw: Column) -> Column:
    """A map of the "key: value" lines of the head between --- lines; the last of
    repeated keys counts."""
    head = F.regexp_extract(raw, _FRONT, 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.contains(":") & ~x.rlike(r"^\s*#") & (F.trim(x) != ""))
    value = lambda x: F.regexp_replace(F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))), "^[\"']+|[\"']+$", "")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), value(x).alias("value")))
    last = F.filter(pairs, lambda p: F.lit(True))
    keys = F.array_distinct(F.transform(last, lambda p: p["key"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, values)


def body(raw: Column) -> Column:
    return F.when(raw.rlike(_FRONT), F.regexp_extract(raw, _FRONT, 2)).otherwise(raw)


def documents_of(files: DataFrame, departments: DataFrame | None = None) -> DataFrame:
    """docs from (path, stem, raw) rows; departments: code, name."""
    rows = files.select("path", "stem", frontmatter(F.col("raw")).alias("frontmatter"), T.strip(body(F.col("raw"))).alias("body"))

    def get(key: str) -> Column:
        return F.col("frontmatter").getItem(key)

    from_id = F.regexp_extract(F.coalesce(get("sop_id"), F.col("stem")), r"SOP-([A-Z]{2,4})-", 1)
    code = F.coalesce(get("department_code"), F.when(from_id != "", from_id), F.lit("UNK"))
    rows = rows.select(
        F.coalesce(get("sop_id"), F.col("stem")).alias("sop_id"),
        F.coalesce(get("title"), get("sop_id"), F.col("stem")).alias("title"),
        code.alias("department"),
        F.coalesce(get("version"), F.lit("")).alias("version"),
        F.lower(F.coalesce(get("language"), F.lit("en"))).alias("language"),
        F.coalesce(get("owner"), F.lit("")).alias("owner"),
        F.coalesce(get("effective_date"), F.lit("")).alias("effective_date"),
        F.coalesce(get("next_review"), F.lit("")).alias("next_review"),
        F.coalesce(get("status"), F.lit("Effective")).alias("status"),
        get("parent").alias("parent_id"),
        "frontmatter",
        "body",
        "path",
    )
    if departments is not None:
        names = departments.select(F.col("code").alias("department"), F.col("name").alias("known"))
        rows = rows.join(names, "department", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("string"))
    rows = rows.withColumn("department_name", F.coalesce("known", get("department"), F.col("department"))).drop("known")
    return rows.withColumn("full_text", T.strip(F.concat_ws("\n", "title", "body")))


def load_documents(spark: SparkSession, folder: str, departments: DataFrame | None = None) -> DataFrame:
    return documents_of(read_files(spark, folder), departments)


def from_table(table: DataFrame, id: str = "doc_id", text: str = "text", language: str = "lang", department: str = "source") -> DataFrame:
    """docs from a plain table of texts."""
    return table.select(
        F.col(id).cast("string").alias("sop_id"),
        F.concat(F.lit("Document "), F.col(id).cast("string")).alias("title"),
        F.col(department).alias("department"),
        F.lit("").alias("version"),
        F.col(language).alias("language"),
        F.lit("").alias("owner"),
        F.lit("").alias("effective_date"),
        F.lit("").alias("next_review"),
        F.lit("Effective").alias("status"),
        F.lit(None).cast("string").alias("parent_id"),
        F.create_map().cast("map<string,string>").alias("frontmatter"),
        F.coalesce(text, F.lit("")).alias("body"),
        F.lit(None).cast("string").alias("path"),
        F.col(department).alias("department_name"),
        F.coalesce(text, F.lit("")).alias("full_text"),
    )


def english(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("language") == "en")


def has_documents(spark: SparkSession, folder: str) -> bool:
    """Whether a folder, wherever Spark can reach it, is there and holds documents."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return there.exists(path) and not read_files(spark, folder).isEmpty()


def choose_folder(spark: SparkSession, given: str | None, own: str, sample: str) -> str:
    """The folder that is given; else one's own if it holds documents; else the sample."""
    return given or (own if has_documents(spark, own) else sample)


def statistics(docs: DataFrame) -> DataFrame:
    """One row: documents, english, others, departments."""
    english_ = F.count_if(F.col("language") == "en")
    return docs.agg(F.count("*").alias("documents"), english_.alias("english"), (F.count("*") - english_).alias("others"), F.count_distinct("department").alias("departments"))


# --- configuration ---------------------------------------------------------------

_TOPICS = "struct<topics:array<struct<topic:string,dept:string,expected_min:int,expected_max:int>>>"
_REGULATION = "struct<current:string,topic:string,supersedes:string,outdated_designations:array<string>,note:string>"


def load_config(spark: SparkSession, *paths: str) -> DataFrame:
    """One row of the top-level keys as JSON strings; later files override earlier."""
    merged: DataFrame | None = None
    for k, path in enumerate(paths):
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"), F.lit(k).alias("k"))
        merged = raw if merged is None else merged.union(raw)
    entries = merged.select("k", F.explode("m").alias("key", "value"))
    last = entries.groupBy("key").agg(F.max_by("value", "k").alias("value"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("config"))


def departments(config: DataFrame) -> DataFrame:
    """code, name"""
    pairs = config.select(F.explode(F.from_json(F.col("config")["departments"], "map<string,string>")).alias("code", "name"))
    return pairs


def coverage_bands(config: DataFrame) -> DataFrame:
    """pos, topic, dept, expected_min, expected_max"""
    topics = F.from_json(F.col("config")["coverage_requirements"], _TOPICS)["topics"]
    return config.select(F.posexplode(topics).alias("pos", "t")).select("pos", "t.*")


def duplicate_groups(config: DataFrame) -> DataFrame:
    """group, member of the near-duplicate groups that a manifest names."""
    groups = F.from_json(F.col("config")["near_duplicate_groups"], "array<struct<`group`:string,members:array<string>>>")
    return config.select(F.explode(groups).alias("g")).select(F.col("g.group").alias("group"), F.explode("g.members").alias("member")).distinct()


def regulations(config: DataFrame) -> DataFrame:
    """canonical, current, topic, supersedes, outdated; entries that are no objects go."""
    entries = config.select(F.explode(F.from_json(F.col("config")["regulatory_current_versions"], "map<string,string>")).alias("canonical", "value"))
    entries = entries.filter(F.col("value").startswith("{")).select("canonical", F.from_json("value", _REGULATION).alias("r"))
    return entries.select("canonical", "r.current", "r.topic", "r.supersedes", F.coalesce("r.outdated_designations", F.array()).alias("outdated"))
