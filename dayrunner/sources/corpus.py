"""Corpora of worked examples and question lists as (source, kind, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The labels of the example files.
EXAMPLE_LABEL = r"(?m)^example_(\d+):[ \t]*$"
FEED_FIELD = r"(?m)^\s*feed:\s*(.+?)\s*$"
QUESTION_FIELD = r"(?m)^\s*question:\s*(.+?)\s*$"
ANSWER_FIELD = r"(?ms)^\s*answer:\s*\|\s*?\n(.*)\z"


def _whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")
    )


def _field(block: Column, pattern: str) -> Column:
    value = F.regexp_replace(F.trim(F.regexp_extract(block, pattern, 1)), '^"+|"+$', "")
    return F.when(value != "", value)


def _dedented(answer: Column) -> Column:
    """Lines lose eight leading spaces, else four; blank ends are dropped."""
    lines = F.regexp_replace(answer, r"(?m)^(?: {8}| {4})", "")
    return F.regexp_replace(lines, r"^\n+|\n+\z", "")


def parse_examples(files: DataFrame, kind: str) -> DataFrame:
    """Worked examples of whole files (path, raw): one row per ``example_N:`` block.

    Text is 'feed', 'question' and 'answer' where they are found, else the block.
    """
    parts = F.split("raw", EXAMPLE_LABEL)
    numbers = F.regexp_extract_all("raw", F.lit(EXAMPLE_LABEL), F.lit(1))
    blocks = (
        files.select("path", F.slice(parts, 2, F.size(numbers)).alias("bodies"), numbers.alias("numbers"))
        .select("path", "numbers", F.posexplode("bodies").alias("i", "body"))
        .select("path", F.col("i").alias("position"), F.element_at("numbers", F.col("i") + 1).alias("number"), "body")
    )
    body = F.col("body")
    raw_answer = F.regexp_extract(body, ANSWER_FIELD, 1)
    stripped = F.regexp_replace(raw_answer, r"\s+\z", "")
    answer = F.when(body.rlike(ANSWER_FIELD), _dedented(stripped))
    found = blocks.select(
        "path", "position", "number", "body",
        _field(body, FEED_FIELD).alias("feed"), _field(body, QUESTION_FIELD).alias("question"), answer.alias("answer"),
    )
    full = F.concat_ws(
        "\n",
        F.concat(F.lit("feed: "), "feed"), F.concat(F.lit("question: "), "question"),
        F.concat(F.lit("answer:\n"), F.when(F.col("answer") != "", F.col("answer"))),
    )
    whole = F.concat(F.lit("example_"), "number", F.lit(":"), F.regexp_replace("body", r"\s+\z", ""))
    empty = F.col("question").isNull() & (F.coalesce("answer", F.lit("")) == "")
    return found.select(
        F.concat("path", F.lit("#example_"), "number").alias("source"), F.lit(kind).alias("kind"),
        F.when(empty, whole).otherwise(full).alias("text"), "position",
    )


def parse_questions(files: DataFrame, kind: str) -> DataFrame:
    """Question lists of whole files (path, raw): the strings of a JSON array,
    trimmed, blanks dropped; its other items and other JSON give no rows."""
    parsed = F.try_parse_json("raw")
    elements = F.try_variant_get(parsed, "$", "array<variant>")
    items = F.transform(elements, lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")))
    question = F.regexp_replace("item", r"^\s+|\s+\z", "")
    return (
        files.select("path", F.posexplode(items).alias("position", "item"))
        .withColumn("text", question).filter("text <> ''")
        .select(
            F.concat("path", F.lit("["), F.col("position").cast("string"), F.lit("]")).alias("source"),
            F.lit(kind).alias("kind"), "text", "position",
        )
    )


def read_corpus(
    spark: SparkSession, *, examples: dict[str, str] | None = None, questions: dict[str, str] | None = None
) -> DataFrame:
    """Corpus out of files, path -> kind; paths that do not exist give no rows.

    ``doc_id`` orders the corpus by file (in the order given) and position.
    """
    parts = []
    for parse, files in ((parse_examples, examples), (parse_questions, questions)):
        for path, kind in (files or {}).items():
            if not _exists(spark, path):
                continue
            docs = parse(_whole_files(spark, [path]), kind)
            order = F.lit(len(parts)).cast("bigint") * F.lit(2**32)
            parts.append(docs.withColumn("doc_id", order + F.col("position")).drop("position"))
    out = parts[0] if parts else spark.createDataFrame([], "source string, kind string, text string, doc_id bigint")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "kind", "text")


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except AnalysisException:
        return False
