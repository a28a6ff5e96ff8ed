"""Task generators on a lexicon made of the documents' words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chars, syllables, tokens
from ..plans import lexicon as lexicons
from ..plans import tasks
from . import task_sql
from .base import WORDS_SQL, query, raw_words, words


def _lexicon(spark, sf_dir):
    rows = words(spark, sf_dir).where(F.length("word") >= 3)
    s = syllables.syllabify(F.col("word"))
    rows = rows.select("word", chars.normalize_text(F.col("word")).alias("normalized_word"), s.alias("syllable_list"))
    return rows.select(
        "word", "normalized_word", F.lit("pnb").alias("part_of_speech"), F.transform("syllable_list", chars.normalize_text).alias("normalized_syllable_list"),
        syllables.accented_syllable(F.col("syllable_list"))["at"].cast("bigint").alias("accented_syllable_index"),
        syllables.stress_type(syllables.last_syllable(F.col("syllable_list"))).alias("last_syllable_pronunciation"),
    )


def _written(spark, sf_dir):
    """Words as they are written, capitals kept, with their form without marks."""
    rows = raw_words(spark, sf_dir).select(F.col("w").alias("word")).where(F.length("word") >= 3).distinct()
    return rows.select("word", chars.normalize_text(F.col("word")).alias("normalized_word"))


def _annotated(spark, sf_dir):
    rows = words(spark, sf_dir).where(F.length("word") >= 6)
    head, tail = F.substring("word", 1, 2), F.substr("word", F.length("word") - 1)
    even = F.length("word") % 2 == 0
    return rows.select("word", F.when(even, F.substr("word", F.lit(3))).otherwise(F.substr("word", F.lit(1), F.length("word") - 2)).alias("root"), F.when(even, head).alias("prefix"), F.lit(None).cast("string").alias("infix"), F.when(~even, tail).alias("suffix"))


def _shown(made):
    return made.select("category", "subcategory", "text_en", "text_tl", "answer", F.array_join("wrong", "|").alias("wrong"), "key")


@query(task_sql.composition("mcq"))
def composition_mcq(spark, sf_dir):
    return _shown(tasks.composition(_written(spark, sf_dir), 20))


@query(task_sql.composition("gen"))
def composition_gen(spark, sf_dir):
    return _shown(tasks.composition(_written(spark, sf_dir), 20, "gen"))


@query(task_sql.manipulation("mcq"))
def manipulation_mcq(spark, sf_dir):
    return _shown(tasks.manipulation(_written(spark, sf_dir), 20))


@query(task_sql.manipulation("gen"))
def manipulation_gen(spark, sf_dir):
    return _shown(tasks.manipulation(_written(spark, sf_dir), 20, "gen"))


@query(task_sql.syllabification("mcq"))
def syllabification_mcq(spark, sf_dir):
    return _shown(tasks.syllabification(_lexicon(spark, sf_dir), 20))


@query(task_sql.syllabification("gen"))
def syllabification_gen(spark, sf_dir):
    return _shown(tasks.syllabification(_lexicon(spark, sf_dir), 20, "gen"))


@query(task_sql.stress_benchmark())
def stress_benchmark_mcq(spark, sf_dir):
    return _shown(tasks.stress(_lexicon(spark, sf_dir), 20))


@query(task_sql.word_levels("mcq"))
def hierarchical_words_mcq(spark, sf_dir):
    return _shown(tasks.word_levels(words(spark, sf_dir), 20))


@query(task_sql.word_levels("gen"))
def hierarchical_words_gen(spark, sf_dir):
    return _shown(tasks.word_levels(words(spark, sf_dir), 20, "gen"))


@query(task_sql.affix_levels())
def hierarchical_affixes_mcq(spark, sf_dir):
    return _shown(tasks.affix_levels(_annotated(spark, sf_dir), 20))


@query(task_sql.MCQ_ITEMS)
def mcq_items(spark, sf_dir):
    """Each item with the place of its right answer, which the options are read from."""
    made = tasks.mcq_items(tasks.manipulation(_written(spark, sf_dir), 20))
    prompt = F.col("prompts")[0]
    right = F.element_at(F.array(*[prompt[f"choice{i + 1}"] for i in range(4)]), F.instr(F.lit("ABCD"), F.col("label")))
    return made.select("subcategory", "key", prompt["text_en"].alias("text_en"), right.alias("answer"), "label")


@query(f"""SELECT lpad(g::VARCHAR, 12, '0') AS key, array_to_string(ws, '|') AS words FROM {task_sql.rounds('length', 100_000)}""")
def groups_in_rounds(spark, sf_dir):
    """More groups than one round finds, so the words left are grouped again until the rounds are over."""
    made = tasks.enough_groups(_written(spark, sf_dir), "length", 100_000)
    return made.select(F.lpad(F.col("group_id").cast("string"), 12, "0").alias("key"), F.array_join("words", "|").alias("words"))


FOLD = f"translate(word, '{chars.MARKED}', '{chars.PLAIN}')"
ENDS = f"CASE WHEN regexp_matches(word, '[{chars.ACUTE}]') THEN 'a' WHEN regexp_matches(word, '[{chars.GRAVE}]') THEN 'g' WHEN regexp_matches(word, '[{chars.CIRCUMFLEX}]') THEN 'c' ELSE 'm' END"


@query(f"SELECT {FOLD} AS folded, count(*) AS n_entries FROM {WORDS_SQL} GROUP BY 1 HAVING count(DISTINCT {ENDS}) > 1")
def homographs(spark, sf_dir):
    """Words that are one without marks, with the stress of the whole word."""
    rows = words(spark, sf_dir).select("word", chars.normalize_diacritics(F.col("word")).alias("normalized_word"), F.lit("pnb").alias("part_of_speech"), F.lit(0).cast("bigint").alias("accented_syllable_index"), F.array("word").alias("normalized_syllable_list"), syllables.stress_type(F.col("word")).alias("last_syllable_pronunciation"))
    return tasks.homographs(rows).select("folded", F.size("entries").cast("bigint").alias("n_entries"))


def _group_sql(least: bool) -> str:
    pick, label = ("min", "Which option contains the least number of characters?") if least else ("max", "Which option contains the most number of characters?")
    return f"""WITH w AS (SELECT word, length(word) AS n, row_number() OVER (ORDER BY md5('100|' || word), word) - 1 AS r FROM {WORDS_SQL} WHERE length(word) >= 3),
      g AS (SELECT r // 4 AS g, count(*) AS c, count(DISTINCT n) AS d, arg_{pick}(word, n) AS answer FROM w GROUP BY 1)
      SELECT g AS group_id, answer, '{label}' AS question FROM g WHERE c = 4 AND d = 4"""


def _length_groups(spark, sf_dir, kind):
    rows = words(spark, sf_dir).where(F.length("word") >= 3).select("word", F.col("word").alias("normalized_word"))
    from ..functions.seeded import order_key
    from ..operators.ordering import groups_of_four

    groups = groups_of_four(rows.withColumn("_order", order_key(100, F.col("word"))), "_order", "normalized_word")
    made = tasks.group_task(groups, kind)
    return made.select(F.col("key").cast("bigint").alias("group_id"), "answer", F.col("text_en").alias("question"))


@query(_group_sql(False))
def group_of_four_longest(spark, sf_dir):
    return _length_groups(spark, sf_dir, "length_most")


@query(_group_sql(True))
def group_of_four_shortest(spark, sf_dir):
    return _length_groups(spark, sf_dir, "length_least")


@query(task_sql.GROUP_CHARACTERS)
def group_of_four_characters(spark, sf_dir):
    return _length_groups(spark, sf_dir, "character_most")


@query("""SELECT id AS pair, (id // 100)::VARCHAR || '+' || (id % 100)::VARCHAR || '=' AS question, (id // 100 + id % 100)::VARCHAR AS answer, reverse((id // 100 + id % 100)::VARCHAR) AS reversed_answer,
    CASE WHEN r <= 900 THEN 'train' ELSE 'val' END AS split FROM (SELECT id, row_number() OVER (ORDER BY (id * 48271 + 5) % 2147483647, id) AS r FROM range(1000, 10000) t(id)) WHERE r <= 1000""")
def addition_questions(spark, sf_dir):
    return tasks.sums(spark, 2, 900, 100, seed=5)


@query(task_sql.ADDITION_OPTIONS)
def addition_options(spark, sf_dir):
    made = tasks.sum_options(tasks.sums(spark, 2, 90, 10))
    return made.select("question", "answer", F.array_join("wrong", "|").alias("wrong"))


def _game(game):
    def run(spark, sf_dir):
        often = raw_words(spark, sf_dir).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n")).where("n >= 2 AND length(word) <= 11").orderBy(F.desc("n"), "word").limit(1000)
        made = tasks.language_games(often.select("word"), game, 50)
        return made.select("id", "question", "answer", F.array_join("options", "|").alias("options"))

    run.__name__ = f"langgame_{game}"
    query(task_sql.language_game(game))(run)


for _name in ("most", "contains", "starts", "ends", "longest", "shortest"):
    _game(_name)


@query(task_sql.affixation("mcq"))
def affixation_mcq(spark, sf_dir):
    rows = _inflections(spark, sf_dir)
    return _shown(tasks.affixation(rows))


@query(task_sql.affixation("gen"))
def affixation_gen(spark, sf_dir):
    return _shown(tasks.affixation(_inflections(spark, sf_dir), "gen"))


def _inflections(spark, sf_dir):
    rows = _annotated(spark, sf_dir)
    kind = F.when(F.col("prefix").isNotNull(), "prefix").otherwise("suffix")
    return rows.select("root", kind.alias("affix_type"), "prefix", "suffix", "infix", F.col("word").alias("correct"), F.when(F.reverse("word") == F.col("word"), F.concat("word", F.lit("a"))).otherwise(F.reverse("word")).alias("incorrect1"), F.col("root").alias("incorrect2"), F.concat("word", F.lit("s")).alias("incorrect3"))


@query(f"""SELECT word, substr(word, 3) AS root, 'th' AS affix, 2 AS boundary FROM {WORDS_SQL} WHERE starts_with(word, 'th') AND length(word) >= 4
    ORDER BY word LIMIT 50""")
def prefixed_words(spark, sf_dir):
    lex = words(spark, sf_dir).select(F.col("word").alias("normalized_word"), F.array("word").alias("normalized_syllable_list"))
    prefixes = spark.createDataFrame([("th", 0)], "affix STRING, position INT")
    return lexicons.prefixed_words(lex, prefixes, 50).select("word", "root", "affix", F.get("boundaries", F.lit(0)).alias("boundary"))


#: Literal inflections of every kind, with what an annotation of them holds.
KNOWN = [
    ("takbo", "tumakbo", "-um-", "done", "actor", "um", "infix", "t|um|akbo", "root_part|infix|root_part", "1|3", 1),
    ("luto", "nagluto", "nag-", "done", "actor", "nag", "prefix", "nag|luto", "prefix|root", "3", None),
    ("luto", "lutuan", "-an", None, None, "an", "suffix", "luto|an", "root|suffix", "4", None),
    ("tuwa", "katuwaan", "ka--an", "to come", "place", "ka-an", "circumfix", "ka|tuwa|an", "prefix|root|suffix", "2|6", None),
    ("bili", "pinamili", "-in-", None, None, "in", "infix", "bili|in", "root|infix", "", None),
]


def _annotation_sql() -> str:
    """One annotation a word: the literals first, then each prefix's first 50 of the words that start with it."""
    value = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    known = ", ".join(f"({', '.join(map(value, (k[1], k[0], k[5], k[6], *k[3:5], *k[7:])))}, 'inflections', 0)" for k in KNOWN)
    heuristic = f"""SELECT word, substr(word, 3) AS root, substr(word, 1, 2) AS affix, 'prefix', NULL, NULL, substr(word, 1, 2) || '|' || substr(word, 3), 'prefix|root', '2', NULL, 'heuristic', 1
      FROM (SELECT word, row_number() OVER (PARTITION BY substr(word, 1, 2) ORDER BY word) AS r FROM {WORDS_SQL} WHERE length(word) >= 4 AND substr(word, 1, 2) IN ('th', 'en')) WHERE r <= 50"""
    rows = f"SELECT * FROM (VALUES {known}) t(word, root, affix, affix_type, aspect, focus, morphemes, morpheme_types, boundaries, infix_position, source, o) UNION ALL {heuristic}"
    return f"SELECT * EXCLUDE (o, r) REPLACE (coalesce(infix_position::VARCHAR, '') AS infix_position) FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY o, affix, root) AS r FROM ({rows})) WHERE r = 1"


@query(_annotation_sql())
def annotation_table(spark, sf_dir):
    lex = words(spark, sf_dir).select(F.col("word").alias("normalized_word"), F.array("word").alias("normalized_syllable_list"))
    heuristic = lexicons.prefixed_words(lex, spark.createDataFrame([("th", 0), ("en", 1)], "affix STRING, position INT"), 50)
    known = spark.createDataFrame([k[:5] for k in KNOWN], "root STRING, inflected STRING, aspect_affix STRING, aspect STRING, focus STRING")
    made = lexicons.build_annotations(lexicons.annotate_inflections(known), heuristic)
    joined = [F.array_join(c, "|").alias(c) for c in ("morphemes", "morpheme_types", "boundaries")]
    return made.select("word", "root", "affix", "affix_type", "aspect", "focus", *joined, F.coalesce(F.col("infix_position").cast("string"), F.lit("")).alias("infix_position"), "source")


@query(f"SELECT word, CASE WHEN contains(word, 'an') AND length(word) > 3 THEN (strpos(word, 'an') - 1)::INT END AS at FROM {WORDS_SQL} WHERE contains(word, 'an') AND strpos(word, 'an') > 1 AND length(word) > 3")
def infix_positions(spark, sf_dir):
    rows = words(spark, sf_dir).where(F.contains("word", F.lit("an")) & (F.instr("word", "an") > 1) & (F.length("word") > 3))
    at = F.instr("word", "an")
    root = F.concat(F.substr("word", F.lit(1), at - 1), F.substr("word", at + 2))
    found = tokens.infix_position(F.col("word"), root, F.lit("an"))
    return rows.select("word", found.alias("at"))


@query(task_sql.LEXICON_BUILD)
def lexicon_build(spark, sf_dir):
    raw = words(spark, sf_dir).select("word", F.lit("Tag").alias("etymology"), F.lit("pnb").alias("part_of_speech"), F.lit("").alias("word_sense"))
    return lexicons.build_lexicon(raw).select("word", "normalized_word", "accented_syllable", "accented_syllable_index", "last_syllable", "last_syllable_pronunciation")
