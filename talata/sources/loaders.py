"""Benchmark loaders by name: each gives (sample_id, prefix, ground_truth, false_options)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seeded import order_key
from ..operators.ordering import with_row_index
from . import schemas
from .readers import in_file_order, jsonl

COLUMNS = ["sample_id", "prefix", "ground_truth", "false_options"]
SEED = 42
#: Task types of the character benchmark. Fixed values.
CUTE_TASKS = ["spell", "spell_inverse", "contains_char", "contains_word", "orth", "sem", "ins_char", "ins_word", "del_char", "del_word", "sub_char", "sub_word", "swap_char", "swap_word"]


def _rows(df: DataFrame, prefix: Column, truth: Column, false: Column | None, sample_id: Column | None = None, shuffle: bool = True) -> DataFrame:
    out = df.select(
        (F.col("id") if sample_id is None else sample_id).cast("string").alias("sample_id"),
        prefix.alias("prefix"),
        truth.cast("string").alias("ground_truth"),
        (F.array().cast("array<string>") if false is None else false).alias("false_options"),
    )
    return out.orderBy(order_key(SEED, F.col("sample_id"), F.col("prefix"))) if shuffle else out


def _others(options: Column, truth: Column) -> Column:
    return F.filter(options, lambda o: o != truth)


def pacute(spark: SparkSession, folder: str, *, form: str = "mcq", categories: list[str] | None = None) -> DataFrame:
    """All categories' files of the asked form (mcq or gen)."""
    path = f"{folder}/{form}_*.jsonl"
    rows = jsonl(spark, path, schemas.MCQ_NESTED if form == "mcq" else schemas.GEN_NESTED)
    if categories is not None:
        rows = rows.where(F.lower("category").isin([c.lower() for c in categories]))
    p = F.get("prompts", F.lit(0))
    text = F.coalesce(p["text_tl"], p["text_en"])
    if form == "gen":
        return _rows(rows, text, F.col("label"), None)
    o = p["mcq_options"]
    return _rows(rows, text, o["correct"], F.array(o["incorrect1"], o["incorrect2"], o["incorrect3"]))


def hierarchical(spark: SparkSession, path: str, *, form: str = "mcq") -> DataFrame:
    """The truth is ``answer``, wherever it stands among the options."""
    rows = jsonl(spark, path, schemas.HIERARCHICAL)
    text = F.coalesce("prompt_tl", "question")
    if form == "gen":
        return _rows(rows, text, F.col("answer"), None)
    return _rows(rows.where(F.size("options") > 0), text, F.col("answer"), _others(F.col("options"), F.col("answer")))


def langgame(spark: SparkSession, path: str, *, form: str = "mcq") -> DataFrame:
    """The first option is the truth."""
    rows = jsonl(spark, path, schemas.FLAT)
    if form == "gen":
        return _rows(rows, F.col("question"), F.col("answer"), None)
    return _rows(rows, F.col("question"), F.get("options", F.lit(0)), F.slice("options", F.lit(2), F.greatest(F.size("options") - 1, F.lit(0))))


def addition(spark: SparkSession, path: str, *, form: str = "gen", max_samples: int = 1000) -> DataFrame:
    """The first ``max_samples`` lines."""
    rows = in_file_order(jsonl(spark, path, schemas.FLAT)).orderBy("position").limit(max_samples)
    if form == "gen":
        return _rows(rows, F.col("question"), F.col("answer"), None)
    return _rows(rows, F.col("question"), F.get("options", F.lit(0)), F.slice("options", F.lit(2), F.greatest(F.size("options") - 1, F.lit(0))))


def cute(spark: SparkSession, path: str, *, task_types: list[str] | None = None, max_per_task: int | None = None) -> DataFrame:
    """The asked task types, ``max_per_task`` rows of each in a seeded order."""
    from ..operators.ordering import first_per_group

    rows = jsonl(spark, path, schemas.FLAT).where(F.col("task_type").isin(task_types or CUTE_TASKS))
    rows = rows.withColumn("_order", order_key(SEED, F.col("id"), F.col("question")))
    if max_per_task is not None:
        rows = first_per_group(rows, max_per_task, ["task_type"], "_order")
    return _rows(rows, F.col("question"), F.col("answer"), None)


def arc(spark: SparkSession, path: str) -> DataFrame:
    """The option whose label is the key."""
    rows = jsonl(spark, path, "id STRING, question STRING, choices STRUCT<text:ARRAY<STRING>,label:ARRAY<STRING>>, answerKey STRING")
    at = F.array_position("choices.label", F.col("answerKey")).cast("int")
    false = F.transform(F.filter(F.arrays_zip(F.col("choices.text").alias("t"), F.col("choices.label").alias("l")), lambda c: c["l"] != F.col("answerKey")), lambda c: c["t"])
    return _rows(rows.where(at > 0), F.concat(F.lit("Question: "), "question", F.lit("\nAnswer:")), F.get("choices.text", at - 1), false)


def blimp(spark: SparkSession, path: str, *, split: str = "test") -> DataFrame:
    """Good against bad sentences; index ranges of 10, 50 and 40 percent."""
    from ..operators.sampling import range_split

    rows = in_file_order(jsonl(spark, path, "id STRING, sentence_good STRING, sentence_bad STRING"))
    total = rows.count()
    rows = with_row_index(rows, "position")
    name = range_split(F.col("row_index"), total, {"validation": 0.1, "train": 0.5, "test": 0.4})
    return _rows(rows.where(name == split), F.lit(""), F.col("sentence_good"), F.array("sentence_bad"), F.coalesce("id", F.col("row_index").cast("string")))


def hellaswag(spark: SparkSession, path: str, *, half: int | None = None) -> DataFrame:
    """endings[label] is the truth; ``half`` 0 or 1 takes that half of the file."""
    rows = in_file_order(jsonl(spark, path, "id STRING, ctx STRING, endings ARRAY<STRING>, label STRING"))
    if half is not None:
        total = rows.count()
        rows = with_row_index(rows, "position")
        rows = rows.where(F.col("row_index") < total // 2) if half == 0 else rows.where(F.col("row_index") >= total // 2)
    truth = F.get("endings", F.col("label").cast("int"))
    return _rows(rows, F.col("ctx"), truth, _others(F.col("endings"), truth), F.coalesce("id", F.col("position").cast("string")))


def mmlu(spark: SparkSession, path: str) -> DataFrame:
    """Choices are rendered with all options; the truth is not among the false ones."""
    rows = jsonl(spark, path, "id STRING, question STRING, choices ARRAY<STRING>, answer INT")
    shown = F.concat(F.lit("Options: "), F.array_join("choices", ";"), F.lit("\n Answer: "))
    truth = F.get("choices", F.col("answer"))
    false = F.transform(F.filter(F.arrays_zip(F.col("choices").alias("c"), F.sequence(F.lit(0), F.size("choices") - 1).alias("i")), lambda x: x["i"] != F.col("answer")), lambda x: F.concat(shown, x["c"]))
    return _rows(rows, F.col("question"), F.concat(shown, truth), false)


def winogrande(spark: SparkSession, path: str) -> DataFrame:
    """The blank filled with either option."""
    rows = jsonl(spark, path, "id STRING, sentence STRING, option1 STRING, option2 STRING, answer STRING")
    fill = lambda c: F.replace("sentence", F.lit("_"), F.col(c))
    first = F.col("answer") == "1"
    return _rows(rows, F.lit(""), F.when(first, fill("option1")).otherwise(fill("option2")), F.array(F.when(first, fill("option2")).otherwise(fill("option1"))))


Loader = Callable[..., DataFrame]
CATEGORIES = ["affixation", "composition", "manipulation", "syllabification"]
LOADERS: dict[str, Loader] = {
    **{f"pacute{s}": partial(pacute, form=f) for s, f in (("", "mcq"), ("-mcq", "mcq"), ("-gen", "gen"))},
    **{f"pacute-{c}{s}": partial(pacute, form=f, categories=[c]) for c in CATEGORIES for s, f in (("", "mcq"), ("-mcq", "mcq"), ("-gen", "gen"))},
    "hierarchical": hierarchical,
    "hierarchical-mcq": hierarchical,
    "hierarchical-gen": partial(hierarchical, form="gen"),
    "langgame": langgame,
    "langgame-mcq": langgame,
    "langgame-gen": partial(langgame, form="gen"),
    "multi-digit-addition": addition,
    "multi-digit-addition-mcq": partial(addition, form="mcq"),
    "multi-digit-addition-gen": addition,
    "cute": cute,
    "arc": arc,
    "blimp": blimp,
    "hellaswag": hellaswag,
    "mmlu": mmlu,
    "winogrande": winogrande,
}


def load_benchmark(spark: SparkSession, name: str, path: str, *, max_samples: int | None = None, **options) -> DataFrame:
    """By name; a name without its form falls back to the family's loader."""
    loader = LOADERS.get(name) or LOADERS.get(name.rsplit("-", 1)[0])
    if loader is None:
        raise ValueError(f"unknown benchmark: {name}; known: {', '.join(sorted(LOADERS))}")
    rows = loader(spark, path, **options)
    return rows if max_samples is None else rows.limit(max_samples)


def collect_tasks(spark: SparkSession, name: str, path: str, *, max_samples: int | None = None, **options) -> list[dict]:
    """The tasks of a benchmark as (prefix, ground_truth, false_options) for an evaluation on the driver.

    They are as many as the benchmark file holds, or ``max_samples``. ``name`` may carry a category or a split.
    """
    rows = load_benchmark(spark, name, path, max_samples=max_samples, **options)
    return [r.asDict() for r in rows.select("prefix", "ground_truth", "false_options").collect()]
