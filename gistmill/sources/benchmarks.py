"""Conversation benchmarks in JSON, as turns and questions.

A file holds one list; each of its elements becomes a variant, so that fields which only some elements have are read alike.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of question categories by number, and forms of dates.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}
ABOUT_ASSISTANT = "single-session-assistant"
SPOKEN_DATE = "h:mm a 'on' d MMMM, yyyy"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each element of the file's list, as variant ``v``."""
    return spark.read.option("multiLine", True).json(path).select(F.to_variant_object(F.struct("*")).alias("v"))


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _spoken(date: Column) -> Column:
    """A date such as ``1:56 pm on 8 May, 2023``."""
    return F.try_to_timestamp(F.replace(F.replace(F.trim(date), F.lit(" am "), F.lit(" AM ")), F.lit(" pm "), F.lit(" PM ")), F.lit(SPOKEN_DATE))


def spoken_turns(samples: DataFrame) -> DataFrame:
    """conversation_id, session_id, session, date, turn_id, speaker, text of samples whose sessions are numbered fields; captions of photos belong to the text."""
    e = samples.select(_get("v", "$.sample_id").alias("conversation_id"), _get("v", "$.conversation", "map<string,variant>").alias("c"))
    e = e.select("conversation_id", "c", F.explode(F.filter(F.map_keys("c"), lambda k: k.rlike(r"^session_\d+$"))).alias("key"))
    turns = F.explode(_get(F.element_at("c", F.col("key")), "$", "array<variant>"))
    date = _spoken(_get(F.element_at("c", F.concat("key", F.lit("_date_time"))), "$"))
    number = F.substring_index("key", "_", -1)
    e = e.select("conversation_id", F.concat_ws("-s", "conversation_id", number).alias("session_id"), number.cast("int").alias("session"), date.alias("date"), turns.alias("t"))
    said, caption = F.trim(F.coalesce(_get("t", "$.text"), F.lit(""))), _get("t", "$.blip_caption")
    text = F.when(F.coalesce(caption, F.lit("")) != "", F.trim(F.concat(said, F.lit(" [shares a photo of "), caption, F.lit("]")))).otherwise(said)
    e = e.select("conversation_id", "session_id", "session", "date", _get("t", "$.dia_id").alias("turn_id"), _get("t", "$.speaker").alias("speaker"), text.alias("said")).filter("said != ''")
    return e.select("conversation_id", "session_id", "session", "date", "turn_id", "speaker", F.concat_ws(": ", "speaker", "said").alias("text"))


def spoken_questions(samples: DataFrame, adversarial: bool = False) -> DataFrame:
    """conversation_id, question_id, question, answer, category, evidence (turn ids), abstention."""
    e = samples.select(_get("v", "$.sample_id").alias("conversation_id"), F.posexplode(_get("v", "$.qa", "array<variant>")).alias("n", "q"))
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    category = F.coalesce(F.element_at(names, _get("q", "$.category", "int")), F.lit("unknown"))
    e = e.select(
        "conversation_id", F.concat_ws("-q", "conversation_id", "n").alias("question_id"), _get("q", "$.question").alias("question"), F.coalesce(_get("q", "$.answer"), F.lit("")).alias("answer"), category.alias("category"),
        F.coalesce(_get("q", "$.evidence", "array<string>"), F.array().cast("array<string>")).alias("evidence"),
    ).withColumn("abstention", F.col("category") == "adversarial")
    return e if adversarial else e.filter("NOT abstention")


def haystack_turns(items: DataFrame, about_assistant: bool = False) -> DataFrame:
    """conversation_id, session_id, date, turn_id, role, text of items that hold lists of sessions with their dates."""
    e = items if about_assistant else items.filter(_get("v", "$.question_type") != ABOUT_ASSISTANT)
    dates, ids = _get("v", "$.haystack_dates", "array<string>"), _get("v", "$.haystack_session_ids", "array<string>")
    e = e.select(_get("v", "$.question_id").alias("conversation_id"), dates.alias("dates"), ids.alias("ids"), F.posexplode(_get("v", "$.haystack_sessions", "array<variant>")).alias("n", "s"))
    name = F.coalesce(F.get("ids", F.col("n")), F.concat(F.lit("h"), F.col("n").cast("string")))
    parts = r"^(\d{4})/(\d{2})/(\d{2})\s*\([^)]*\)\s*(\d{2}):(\d{2})"
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(F.get("dates", F.col("n")), parts, 0), parts, "$1-$2-$3 $4:$5"), F.lit("yyyy-MM-dd HH:mm"))
    e = e.filter(F.col("n") < F.size("dates")).select("conversation_id", F.concat_ws("-", "conversation_id", name).alias("session_id"), date.alias("date"), F.posexplode(_get("s", "$", "array<variant>")).alias("k", "t"))
    said = F.trim(F.coalesce(_get("t", "$.content"), F.lit("")))
    role = F.when(_get("t", "$.role") == "assistant", "assistant").otherwise("user")
    return e.select("conversation_id", "session_id", "date", F.concat_ws(":", "session_id", "k").alias("turn_id"), role.alias("role"), said.alias("text")).filter("text != ''")


def haystack_questions(items: DataFrame, about_assistant: bool = False) -> DataFrame:
    """conversation_id, question, answer, category, evidence_sessions, abstention."""
    e = items if about_assistant else items.filter(_get("v", "$.question_type") != ABOUT_ASSISTANT)
    name = _get("v", "$.question_id")
    sessions = F.transform(F.coalesce(_get("v", "$.answer_session_ids", "array<string>"), F.array().cast("array<string>")), lambda x: F.concat_ws("-", name, x))
    return e.select(
        name.alias("conversation_id"), _get("v", "$.question").alias("question"), _get("v", "$.answer").alias("answer"), _get("v", "$.question_type").alias("category"), sessions.alias("evidence_sessions"), F.endswith(name, F.lit("_abs")).alias("abstention")
    )


def corpora(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, v (variant): the cases of evaluation corpora, files of YAML or JSON that hold a list each; one that holds none has no rows.

    A file is read whole by one task, as a list has to be.  YAML needs a parser on the workers.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{json,yaml,yml}").select(F.col("_metadata.file_path").alias("file"), "value")

    def cases(batches):
        import json

        for batch in batches:
            out: list[list] = [[], [], []]
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file.endswith(".json"):
                    found = json.loads(text)
                else:
                    try:
                        import yaml
                    except ImportError as missing:
                        raise RuntimeError(f"{file} is YAML, for which the workers have no parser") from missing
                    found = yaml.safe_load(text)
                for nth, case in enumerate(found if isinstance(found, list) else []):
                    for column, value in zip(out, (file, nth, json.dumps(case, ensure_ascii=False, default=str)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["file", "nth", "json"])

    rows = files.mapInArrow(cases, "file string, nth int, json string")
    return rows.select("file", "nth", F.parse_json("json").alias("v"))
