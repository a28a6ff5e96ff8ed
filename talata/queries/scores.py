"""Scores, profiles and model comparisons on stand-in outcomes: vectors as confidences, labels as results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, profiles, scores
from .base import query, table


def _confidences(spark, sf_dir):
    c = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", c.alias("confidences"))


CONF = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS c FROM embeddings)"
HIT = "CASE WHEN c[1] = list_max(c) THEN 1.0::DOUBLE ELSE 0.0 END"
SOFT = "exp(c[1] - list_max(c)) / list_sum(list_transform(c, lambda x: exp(x - list_max(c))))"
BASE = f"(SELECT label, c, {HIT} AS h, {SOFT} AS s FROM {CONF})"


def _metrics_sql(group: str) -> str:
    lead, tail = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    return f"""SELECT {lead}n_rows, round(a, 6) AS accuracy, round(p, 6) AS path_confidence, round(g, 6) AS ground_confidence, k AS num_options,
      round((a * k - 1) / (k - 1), 6) AS normalized_accuracy, round((p * k - 1) / (k - 1), 6) AS normalized_path_confidence,
      round(x / (x + 1e-10), 6) AS precision, round(x / (n_rows + 1e-10), 6) AS recall,
      round(2 * (x / (x + 1e-10)) * (x / (n_rows + 1e-10)) / (x / (x + 1e-10) + x / (n_rows + 1e-10) + 1e-10), 6) AS f1
      FROM (SELECT {lead}count(*) AS n_rows, avg(h) AS a, avg(s) AS p, avg(c[1]) AS g, sum(h) AS x, max(len(c)) AS k FROM {BASE}{tail})"""


@query(_metrics_sql(""))
def mcq_metrics(spark, sf_dir):
    return scores.calculate_metrics(_confidences(spark, sf_dir))


@query(_metrics_sql("label"))
def mcq_metrics_by_label(spark, sf_dir):
    return scores.calculate_metrics(_confidences(spark, sf_dir), "confidences", "label")


@query(f"SELECT vec_id, (list_position(c, list_max(c)) - 1)::INT AS predicted_idx, round({SOFT}, 6) AS path_confidence FROM {CONF}")
def mcq_predictions(spark, sf_dir):
    c = F.col("confidences")
    return _confidences(spark, sf_dir).select("vec_id", scores.predicted_index(c).alias("predicted_idx"), F.round(scores.first_softmax(c), 6).alias("path_confidence"))


@query(f"SELECT c[1] = list_max(c) AS is_correct, count(*) AS n_rows, round(avg(list_max(c)), 6) AS mean_confidence FROM {CONF} GROUP BY 1")
def mcq_outcome_summary(spark, sf_dir):
    c = F.col("confidences")
    return scores.mcq_summary(_confidences(spark, sf_dir), scores.is_first_best(c), c)


PAIRS = """(SELECT c.conv_id, c.turn, lower(trim(c.text)) AS g, lower(trim(split_part(c.text, ' ', (1 + c.turn % 3)::INT))) AS t FROM conversations c)"""


def _generated(spark, sf_dir):
    truth = F.get(F.split("text", " "), F.col("turn").cast("int") % 3)
    flags = scores.match_flags(F.col("text"), F.coalesce(truth, F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "role", flags.alias("f")).select("conv_id", "role", "f.*")


@query(f"SELECT CASE WHEN g = t THEN 'exact' WHEN contains(g, t) THEN 'contains' WHEN starts_with(g, t) THEN 'prefix' ELSE 'none' END AS bucket, count(*) AS n_rows FROM {PAIRS} GROUP BY 1")
def gen_match_buckets(spark, sf_dir):
    return scores.bucket_counts(_generated(spark, sf_dir))


@query(f"""SELECT count(*) AS n_rows, round(avg((g = t)::INT), 6) AS exact_match_accuracy, round(avg(contains(g, t)::INT), 6) AS contains_match_accuracy, round(avg(starts_with(g, t)::INT), 6) AS prefix_match_accuracy FROM {PAIRS}""")
def gen_accuracy(spark, sf_dir):
    return scores.generative_accuracy(_generated(spark, sf_dir))


@query("SELECT role, count(*) AS n_rows, round(avg(contains(text, 'the')::INT), 6) AS accuracy FROM conversations GROUP BY role")
def answer_found_rate(spark, sf_dir):
    return scores.answer_found(table(spark, sf_dir, "conversations"), F.col("text"), F.lit("the"), "role")


@query("SELECT event_type, count(value) AS n_rows, round(exp(avg(value / 100.0)), 6) AS perplexity FROM events GROUP BY event_type")
def perplexity_by_class(spark, sf_dir):
    return scores.perplexity(table(spark, sf_dir, "events"), -F.col("value") / 100.0, "event_type")


@query("""SELECT vec_id, round(-list_avg(list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x, i: i % 2 = 1)), 6) AS loss FROM embeddings""")
def masked_loss(spark, sf_dir):
    p = F.transform("embedding", lambda x: x.cast("double"))
    mask = F.transform(p, lambda x, i: (i % 2 == 0).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scores.masked_loss(p, mask), 6).alias("loss"))


LEVELED = "(SELECT d.doc_id, (d.doc_id % 6)::INT AS level, d.lang AS subcategory, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"


def _leveled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("subcategory"), "source")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select("doc_id", (F.col("doc_id") % 6).cast("int").alias("level"), "subcategory", "source", "quality", "toxic")


def _profile_sql(group: str, value: str = "quality") -> str:
    return f"SELECT {group}, count(*) AS n_total, sum({value})::BIGINT AS n_correct, round(avg({value}), 6) AS accuracy FROM {LEVELED} GROUP BY {group}"


@query(_profile_sql("level"))
def capability_profile(spark, sf_dir):
    return profiles.profile(_leveled(spark, sf_dir), F.col("quality"), "level")


@query(_profile_sql("level, subcategory"))
def subcategory_profile(spark, sf_dir):
    return profiles.profile(_leveled(spark, sf_dir), F.col("quality"), "level", "subcategory")


P = f"({_profile_sql('level')})"


@query(f"""SELECT from_level, from_accuracy, to_level, to_accuracy FROM (SELECT level AS from_level, accuracy AS from_accuracy, lead(level) OVER (ORDER BY level) AS to_level, lead(accuracy) OVER (ORDER BY level) AS to_accuracy FROM {P})
    WHERE to_level IS NOT NULL AND from_accuracy < 0.9 AND to_accuracy <= from_accuracy""")
def failure_cascade(spark, sf_dir):
    return profiles.failure_cascade(capability_profile(spark, sf_dir), threshold=0.9)


@query(f"SELECT a.level AS level_i, b.level AS level_j, round(a.accuracy / (b.accuracy + 1e-6), 6) AS ratio FROM {P} a JOIN {P} b ON b.level < a.level")
def level_dependency(spark, sf_dir):
    return profiles.level_dependencies(capability_profile(spark, sf_dir))


@query(f"SELECT arg_max(level, (accuracy, -level)) AS best_level, arg_min(level, (accuracy, level)) AS worst_level FROM {P}")
def best_and_worst_level(spark, sf_dir):
    return profiles.best_and_worst(capability_profile(spark, sf_dir))


TOX = f"({_profile_sql('level', '1 - toxic')})"


@query(f"SELECT a.level, a.accuracy AS accuracy_a, b.accuracy AS accuracy_b, round(b.accuracy - a.accuracy, 6) AS difference, abs(round(b.accuracy - a.accuracy, 6)) > 0.05 AS significant FROM {P} a JOIN {TOX} b USING (level)")
def two_model_compare(spark, sf_dir):
    rows = _leveled(spark, sf_dir)
    return profiles.compare_two(profiles.profile(rows, F.col("quality"), "level"), profiles.profile(rows, 1 - F.col("toxic"), "level"))


@query(f"""SELECT level, a.accuracy AS quality, b.accuracy AS clean, CASE WHEN a.accuracy >= b.accuracy THEN 'quality' ELSE 'clean' END AS best_model,
    CASE WHEN a.accuracy <= b.accuracy THEN 'quality' ELSE 'clean' END AS worst_model, round(abs(a.accuracy - b.accuracy), 6) AS accuracy_range FROM {P} a JOIN {TOX} b USING (level)""")
def n_model_pivot(spark, sf_dir):
    rows = _leveled(spark, sf_dir)
    both = profiles.profile(rows, F.col("quality"), "level").withColumn("model", F.lit("quality")).unionByName(profiles.profile(rows, 1 - F.col("toxic"), "level").withColumn("model", F.lit("clean")))
    return profiles.compare_many(both, ["quality", "clean"])


@query(f"SELECT level, doc_id FROM (SELECT level, doc_id, row_number() OVER (PARTITION BY level ORDER BY doc_id) AS r FROM {LEVELED} WHERE quality = 0) WHERE r <= 5")
def first_failures(spark, sf_dir):
    return profiles.failures(_leveled(spark, sf_dir), F.col("quality"), 5, ["level"], "doc_id").select("level", "doc_id")


@query(f"""WITH p AS ({_profile_sql('level')}), q AS ({_profile_sql('level, subcategory')}),
    sub AS (SELECT level, list({{'subcategory': subcategory, 'n_total': n_total, 'n_correct': n_correct, 'accuracy': accuracy}} ORDER BY subcategory) AS subprofile FROM q GROUP BY level),
    bad AS (SELECT level, list({{'doc_id': doc_id}} ORDER BY doc_id) AS failures FROM (SELECT level, doc_id, row_number() OVER (PARTITION BY level ORDER BY doc_id) AS r FROM {LEVELED} WHERE coalesce(quality, 0) = 0) WHERE r <= 5 GROUP BY level)
    SELECT level, replace(to_json({{'level': level, 'n_total': n_total, 'n_correct': n_correct, 'accuracy': accuracy, 'subprofile': subprofile, 'failures': failures}})::VARCHAR, ',"failures":null', '') AS document FROM p LEFT JOIN sub USING (level) LEFT JOIN bad USING (level)""")
def visualization_export(spark, sf_dir):
    rows = _leveled(spark, sf_dir)
    bad = profiles.failures(rows, F.col("quality"), 5, ["level"], "doc_id").select("level", "doc_id")
    return profiles.export(profiles.profile(rows, F.col("quality"), "level"), profiles.profile(rows, F.col("quality"), "level", "subcategory"), bad)


@query(f"SELECT doc_id AS id FROM {LEVELED} WHERE quality <> 1 - toxic")
def common_sample_differences(spark, sf_dir):
    rows = _leveled(spark, sf_dir)
    long = rows.select(F.lit("quality").alias("model"), F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("ok")).unionByName(rows.select(F.lit("clean").alias("model"), F.col("doc_id").alias("id"), (F.col("toxic") == 0).alias("ok")))
    return scores.outcome_differences(long, 2)


MODELS = ["qwen2.5-7b-it", "gemma-2-9b", "llama-3.2-1b-it", "gpt2-large", "sea-lion-v3-8b", "qwen2.5-0.5b"]
NAMED = "(SELECT ['" + "','".join(MODELS) + "'][(doc_id % 6 + 1)::INT] AS model, lang AS benchmark, quality FROM documents JOIN labels USING (doc_id))"


def _scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("benchmark")).join(table(spark, sf_dir, "labels"), "doc_id")
    name = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.groupBy(name.alias("model"), "benchmark").agg(F.round(100.0 * F.avg("quality"), 6).alias("score"))


SCORES = f"(SELECT model, benchmark, round(100.0 * avg(quality), 6) AS score FROM {NAMED} GROUP BY ALL)"
FAMILY = "CASE WHEN contains(model, 'sea-lion') THEN 'SEA-LION' WHEN contains(model, 'qwen') THEN 'Qwen' WHEN contains(model, 'llama') THEN 'LLaMA' WHEN contains(model, 'gemma') THEN 'Gemma' WHEN contains(model, 'gpt2') THEN 'GPT-2' ELSE 'Other' END"


@query(f"SELECT {FAMILY} AS family, benchmark, count(*) AS n_models, round(avg(score), 6) AS mean_score FROM {SCORES} GROUP BY 1, 2")
def family_means(spark, sf_dir):
    return models.family_means(_scores(spark, sf_dir))


@query(f"SELECT model, round(avg(score), 6) AS mean_score FROM {SCORES} GROUP BY model ORDER BY mean_score DESC, model LIMIT 3")
def top_k_models(spark, sf_dir):
    return models.top_models(models.wide_scores(_scores(spark, sf_dir), ["de", "en", "es", "fr"]), 3).select("model", "mean_score")


@query(f"""SELECT DISTINCT model, CASE model WHEN 'qwen2.5-7b-it' THEN 7.0 WHEN 'gemma-2-9b' THEN 9.0 WHEN 'llama-3.2-1b-it' THEN 1.0 WHEN 'gpt2-large' THEN 0.8 WHEN 'sea-lion-v3-8b' THEN 8.0 ELSE 0.5 END::DOUBLE AS size_b,
    ends_with(model, '-it') AS instruct FROM {NAMED}""")
def model_attributes(spark, sf_dir):
    m = F.col("model")
    return _scores(spark, sf_dir).select("model").distinct().select("model", models.model_size(m).alias("size_b"), models.is_instruct(m).alias("instruct"))
