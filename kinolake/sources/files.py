"""Files around the tables: video listings, question sets, line-delimited JSON, answers, dead letters, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolake.functions.ids import video_name
from kinolake.operators.tables import Store, last_by_key

#: Extensions that count as videos.
EXTENSIONS = ("mp4", "mkv", "avi", "mov", "webm")
QUESTIONS = "map<string, array<struct<description: string, type: string, video_url: array<string>, questions: array<struct<id: int, question: string>>>>>"


def list_videos(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``video_name, path, bytes`` of the videos below a folder, by path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
    kind = F.lower(F.substring_index("path", ".", -1))
    return found.filter(kind.isin(*extensions)).select(video_name("path").alias("video_name"), "path", "bytes").orderBy("path")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``collection_id, description, type, video_url, questions`` from ``{id: [{...}]}``; the first entry of each id."""
    text = spark.read.text(path, wholetext=True)
    one = text.select(F.explode(F.from_json("value", QUESTIONS)).alias("collection_id", "entries"))
    return one.select("collection_id", F.get("entries", F.lit(0)).alias("e")).select("collection_id", "e.description", "e.type", "e.video_url", "e.questions")


def write_urls(questions: DataFrame, folder: str) -> None:
    """One text line a video address, partitioned by collection."""
    urls = questions.select("collection_id", F.explode("video_url").alias("value")).distinct()
    urls.repartition("collection_id").write.partitionBy("collection_id").text(folder)


def write_jsonl(rows: DataFrame, folder: str) -> None:
    rows.write.json(folder, ignoreNullFields=False)


def read_jsonl(spark: SparkSession, folder: str, schema: str, key: str = "custom_id") -> tuple[DataFrame, DataFrame]:
    """Rows with a key, and the lines that don't parse or have none (``value``)."""
    lines = spark.read.text(folder)
    parsed = lines.select("value", F.from_json("value", schema).alias("r"))
    good = parsed.filter(F.col(f"r.{key}").isNotNull()).select("r.*")
    bad = parsed.filter(F.col(f"r.{key}").isNull() & (F.trim("value") != "")).select("value")
    return good, bad


def batch_output_to_map(spark: SparkSession, folder: str, key: str = "custom_id") -> tuple[DataFrame, DataFrame]:
    """``custom_id, answer`` from line-delimited batch output (the first choice's text), the last line of an id, and the lines that don't parse."""
    shape = f"{key} string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>"
    good, bad = read_jsonl(spark, folder, shape, key)
    answer = F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"]
    return last_by_key(good.select(key, answer.alias("answer")), key, ["answer"]), bad


def append_answers(store: Store, name: str, answers: DataFrame, key: list[str]) -> None:
    """Adds answers that aren't stored yet; a blank answer is an error, nothing is stored then."""
    blank = answers.filter(F.trim(F.coalesce("answer", F.lit(""))) == "")
    if not blank.isEmpty():
        raise ValueError("a blank answer")
    known = store.read(name, answers.schema)
    fresh = answers.join(known.select(*key), key, "left_anti").dropDuplicates(key)
    store.append(name, fresh)


def keep_dead_letters(store: Store, rows: DataFrame, reason: str, name: str = "dead_letter") -> None:
    """Stores rows that failed, as JSON with the reason."""
    letters = rows.select(F.lit(reason).alias("reason"), F.to_json(F.struct("*")).alias("row"), F.current_timestamp().alias("at"))
    store.append(name, letters)


def write_graph(store: Store, nodes: DataFrame, edges: DataFrame, suffix: str = "") -> None:
    store.commit("nodes" + suffix, nodes)
    store.commit("edges" + suffix, edges)


def read_graph(store: Store, suffix: str = "") -> tuple[DataFrame | None, DataFrame | None]:
    return store.read("nodes" + suffix), store.read("edges" + suffix)
