"""Sources and sinks: files to typed DataFrames, results to files.

Paths are any that Spark's readers open. Listings read names and lengths only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.functions.scalars import MEDIA_SUFFIXES, TEXT_SUFFIXES, basename, file_type, md5_id, modality, normalize_path, parse_date, stem, suffix
from heliodor.operators.reports import latest_by

SEGMENT = "struct<content:string,page_number:int,page:int,start:string,end:string,start_time:double,end_time:double>"
FILE_INFO = "struct<id:string,file_id:string,user:string,file_path:string,file_name:string,file_type:string,file_modality:string,creation_date:string,modification_date:string,QAID:array<string>,QANum:int>"
PARSED_FILE = f"file_info {FILE_INFO}, summary string, hash_tags array<string>, content string, segments array<{SEGMENT}>"
EVIDENCE = "struct<evidence_id:string,file_path:string,evidence_text:string,content:string,page:int,modality_type:string,evidence_locator:array<struct<unit:string,position:struct<system_page:int>>>>"
QUESTION = f"id string, qid string, question string, query string, prompt string, text string, answer string, file_path array<string>, file_number int, file_modality array<string>, file_type array<string>, evidence array<{EVIDENCE}>, rationale array<struct<step_id:int,text:string>>, agent_cap string, QA_type string, profiling_type string, data_source string"
QUESTION_ROOTS = ("questions", "data", "items", "records", "examples", "queries", "results")


def text_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file_id, file_path, file_name, file_type, text: one row a file."""
    df = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    p = F.col("_metadata.file_path")
    return df.select(md5_id(p).alias("file_id"), p.alias("file_path"), basename(p).alias("file_name"), file_type(p).alias("file_type"), F.col("value").alias("text"))


def listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, name, ext, file_type, modality, bytes of files; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", F.col("length").alias("bytes"))
    ext = suffix(F.col("path"))
    return df.select("path", basename(F.col("path")).alias("name"), ext.alias("ext"), file_type(F.col("path")).alias("file_type"), modality(ext).alias("modality"), "bytes")


def known_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """The listing of text and media files, by path."""
    return listing(spark, path, recursive).where(F.col("ext").isin(*TEXT_SUFFIXES, *MEDIA_SUFFIXES)).orderBy("path")


def gold_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, rejects): parsed files in their common form, and those without a usable segment.

    A file may be one object or an array of objects, plain or under `metadata`."""
    raw = spark.read.schema(f"{PARSED_FILE}, metadata struct<{PARSED_FILE.replace(' struct', ':struct').replace(' string', ':string').replace(' array', ':array')}>, _bad string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("_path", F.input_file_name())
    pick = lambda c: F.coalesce(F.col(c), F.col(f"metadata.{c}"))
    df = raw.select(*[pick(c).alias(c) for c in ("file_info", "summary", "hash_tags", "content", "segments")], "_path", "_bad")
    return normalize_gold(df)


def normalize_gold(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = F.array(F.struct(F.col("content").alias("content"), *[F.lit(None).cast(t).alias(n) for n, t in (("page_number", "int"), ("page", "int"), ("start", "string"), ("end", "string"), ("start_time", "double"), ("end_time", "double"))]))
    segments = F.coalesce(F.when(F.size("segments") > 0, F.col("segments")), F.when(F.col("content").isNotNull(), one))
    path = F.coalesce("file_info.file_path", "_path")
    made = df.withColumn("segments", segments).withColumn("file_path", path).select(
        F.coalesce("file_info.id", "file_info.file_id", md5_id(F.col("file_path"))).alias("file_id"), "file_path",
        F.coalesce("file_info.file_name", basename(F.col("file_path"))).alias("file_name"), F.coalesce("file_info.file_type", file_type(F.col("file_path"))).alias("file_type"),
        F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("hash_tags", F.array().cast("array<string>")).alias("hash_tags"), "segments",
    )
    good = F.coalesce((F.size("segments") > 0) & F.forall("segments", lambda s: s["content"].isNotNull()), F.lit(False))
    return made.where(good), made.where(~good)


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """path, place of a list of paths: JSON (a list, or files, file_paths or paths) or lines without comments."""
    whole = spark.read.text(path, wholetext=True)
    text = F.col("value")
    listed = F.coalesce(F.when(F.rlike(text, F.lit(r"^\s*\[")), F.from_json(text, "array<string>")), *[F.from_json(F.get_json_object(text, f"$.{k}"), "array<string>") for k in ("files", "file_paths", "paths")])
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    is_json = F.rlike(text, F.lit(r"^\s*[\[{]"))
    return whole.select(F.posexplode(F.when(is_json, F.coalesce(listed, F.array().cast("array<string>"))).otherwise(lines)).alias("place", "path")).select("path", "place")


def questions(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """query_id, question, answer and the rest, of a list, a root key, an {id: question} map, JSON lines or plain lines."""
    text = F.col("value")
    whole = spark.read.text(path, wholetext=True)
    array = f"array<struct<{_struct(QUESTION)}>>"
    is_list = F.rlike(text, F.lit(r"^\s*\["))
    listed = F.coalesce(F.when(is_list, F.from_json(text, array)), *[F.from_json(F.get_json_object(text, f"$.{k}"), array) for k in QUESTION_ROOTS])
    mapped = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.to_json(F.struct(e["key"].alias("id"), e["value"].alias("question"))))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    from_line = lambda x: F.when(F.rlike(x, F.lit(r"^\s*\{")), x).otherwise(F.to_json(F.struct(F.trim(x).alias("question"))))
    is_map = F.rlike(text, F.lit(r"(?s)^\s*\{.*\}\s*$")) & (F.size(lines) >= 1) & F.from_json(text, "map<string,string>").isNotNull() & ~F.rlike(text, F.lit(r"\}\s*\n\s*\{"))
    strings = F.when(is_map, mapped).otherwise(F.transform(lines, from_line))
    parsed = F.transform(strings, lambda s: F.from_json(s, QUESTION))
    rows = whole.select(F.posexplode(F.coalesce(listed, parsed)).alias("place", "q")).select("place", "q.*")
    asked = F.coalesce(*([F.col(key)] if key else []), "question", "query", "prompt", "text")
    out = rows.select(F.coalesce("id", "qid", (F.col("place") + 1).cast("string")).alias("query_id"), asked.alias("question"), *[c for c in rows.columns if c not in ("place", "id", "qid", "question", "query", "prompt", "text")])
    return out.where(F.trim("question") != "")


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluator input: a JSON list, an object with results or data, or JSON lines."""
    whole = spark.read.text(path, wholetext=True)
    text, array = F.col("value"), f"array<struct<{_struct(schema)}>>"
    listed = F.coalesce(F.when(F.rlike(text, F.lit(r"^\s*\[")), F.from_json(text, array)), *[F.from_json(F.get_json_object(text, f"$.{k}"), array) for k in ("results", "data")])
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, schema))
    return whole.select(F.explode(F.coalesce(listed, lines)).alias("r")).select("r.*")


def file_meta(spark: SparkSession, path: str) -> DataFrame:
    """path, ts of a metadata sheet (CSV): both dates of each file, folders dropped."""
    df = spark.read.option("header", "true").csv(path).where(F.coalesce(F.lower("FileType"), F.lit("")) != "folder")
    each = df.select(normalize_path(F.col("FilePath")).alias("path"), F.explode(F.array(parse_date(F.col("creation_date")), parse_date(F.col("modification_date")))).alias("ts"))
    return each.where("path <> '' AND ts IS NOT NULL")


def metadata_of(files: DataFrame, meta: DataFrame) -> DataFrame:
    """files (path) with the metadata row whose name is {stem}.json, else {name}.json, else that has their stem."""
    m = meta.select(basename(F.col("meta_path")).alias("meta_name"), "meta_path").dropDuplicates(["meta_name"])
    f = files.withColumn("k1", F.concat(stem(F.col("path")), F.lit(".json"))).withColumn("k2", F.concat(basename(F.col("path")), F.lit(".json")))
    by = lambda key, name: m.select(F.col("meta_name").alias(key), F.col("meta_path").alias(name))
    stems = meta.groupBy(stem(F.col("meta_path")).alias("k3")).agg(F.min("meta_path").alias("m3"))
    out = f.join(by("k1", "m1"), "k1", "left").join(by("k2", "m2"), "k2", "left").withColumn("k3", stem(F.col("path"))).join(stems, "k3", "left")
    return out.withColumn("meta_path", F.coalesce("m1", "m2", "m3")).drop("k1", "k2", "k3", "m1", "m2", "m3")


def glob_filter(path: Column, pattern: str) -> Column:
    """Whether a relative path matches a glob, whole or by its name."""
    regex = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "/_" else c) for c in pattern.replace("**", "\0")).replace("\\\0", ".*")
    return F.rlike(path, F.lit(f"^{regex}$")) | F.rlike(basename(path), F.lit(f"^{regex}$"))


def latest_summary(spark: SparkSession, folder: str) -> str | None:
    """The last summary_*.json of a folder, by name."""
    found = listing(spark, folder).where(F.rlike("name", F.lit(r"^summary_.*\.json$"))).agg(F.max_by("path", "name").alias("path")).first()
    return found["path"] if found else None


def profile_lines(profile: DataFrame, most: int = 15) -> DataFrame:
    """user_id, text of a profile (user_id, topics map<string, map<string, string>>): `topic.sub: value` lines."""
    each = profile.select("user_id", F.explode("topics").alias("topic", "subs")).select("user_id", "topic", F.explode("subs").alias("sub", "value")).where("value IS NOT NULL AND value <> ''")
    line = F.concat("topic", F.lit("."), "sub", F.lit(": "), "value")
    return each.groupBy("user_id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("topic", "sub", line.alias("line")))), lambda s: s["line"]), 1, most), "\n").alias("text"))


def evidence(questions: DataFrame) -> DataFrame:
    """query_id, evidence_id, file_path, file_name, pages, content of the expected evidence; both spellings of its keys."""
    e = questions.select("query_id", F.explode("evidence").alias("e"))
    pages = F.transform(F.filter("e.evidence_locator", lambda x: x["unit"] == "page"), lambda x: x["position"]["system_page"])
    return e.where("e.file_path <> ''").select("query_id", "e.evidence_id", "e.file_path", basename(F.col("e.file_path")).alias("file_name"), F.coalesce(F.when(F.size(pages) > 0, pages), F.when(F.col("e.page").isNotNull(), F.array("e.page")), F.array().cast("array<int>")).alias("pages"), F.coalesce("e.evidence_text", "e.content").alias("content"))


def config(text: str) -> dict:
    """A JSON or a flat `key: value` configuration."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    return dict((k.strip(), v.strip()) for k, v in (line.split(":", 1) for line in text.splitlines() if ":" in line and not line.lstrip().startswith("#")))


def write_results(df: DataFrame, path: str, key: str = "query_id") -> None:
    """One folder of JSON a query."""
    df.write.partitionBy(key).mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.option("header", "true").mode("overwrite").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def aggregate_log(rows: DataFrame, dedup: bool = True) -> DataFrame:
    """A run log's last row of each id, else query_id, else file name, by file name."""
    keyed = rows.withColumn("__key", F.coalesce(F.col("id"), F.col("query_id"), F.col("file_name")))
    return (latest_by(keyed, "__key", "file_name") if dedup else keyed).drop("__key")
