"""Character and word functions on the distinct words of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chars, syllables, tokens
from . import sqltext as sq
from .base import WORDS_SQL, number_sql, query, raw_words, words


def _word_query(name: str, made, sql: str) -> None:
    def run(spark, sf_dir):
        return words(spark, sf_dir).select("word", made().alias("result"))

    run.__name__ = name
    query(f"SELECT word, {sql} AS result FROM {WORDS_SQL}")(run)


_word_query("spell_words", lambda: chars.spell(F.col("word")), "array_to_string(string_split(word, ''), ' ')")
_word_query("delete_char", lambda: chars.delete_char(F.col("word"), F.lit("e")), "replace(word, 'e', '')")
_word_query("insert_char", lambda: chars.insert_char(F.col("word"), F.lit("t"), F.lit("x")), "replace(word, 't', 'tx')")
_word_query("substitute_char", lambda: chars.substitute_char(F.col("word"), F.lit("n"), F.lit("m")), "replace(word, 'n', 'm')")
_word_query("permute_char", lambda: chars.permute_char(F.col("word"), F.lit("a"), F.lit("e")), "translate(word, 'ae', 'ea')")
_word_query("duplicate_char", lambda: chars.duplicate_char(F.col("word"), F.lit("o")), "replace(word, 'o', 'oo')")
_word_query("normalize_diacritics", lambda: chars.normalize_diacritics(F.col("word")), f"translate(word, '{chars.MARKED}', '{chars.PLAIN}')")
_word_query("delete_at", lambda: chars.delete_at(F.col("word"), F.lit(2)), "CASE WHEN length(word) >= 2 THEN substr(word, 1, 1) || substr(word, 3) ELSE word END")
_word_query("insert_at", lambda: chars.insert_at(F.col("word"), F.lit(3), F.lit("x")), "CASE WHEN length(word) >= 2 THEN substr(word, 1, 2) || 'x' || substr(word, 3) ELSE word END")
_word_query("substitute_at", lambda: chars.substitute_at(F.col("word"), F.lit(1), F.lit("x")), "'x' || substr(word, 2)")
_word_query(
    "swap_at",
    lambda: chars.swap_at(F.col("word"), F.lit(1), F.lit(3)),
    "CASE WHEN length(word) >= 3 THEN substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 1, 1) || substr(word, 4) ELSE word END",
)
_word_query("char_at", lambda: chars.char_at(F.col("word"), F.lit(2)), "substr(word, 2, 1)")
_word_query("char_count", lambda: chars.count_char(F.col("word"), F.lit("e")).cast("bigint"), "length(word) - length(replace(word, 'e', ''))")
_word_query("diacritic_count", lambda: chars.count_diacritics(F.col("word")).cast("bigint"), f"length(word) - length(regexp_replace(word, '[{chars.DIACRITICS}]', '', 'g'))")
_word_query("word_length", lambda: F.length(F.col("word")).cast("bigint"), "length(word)")
_word_query("capitalize_word", lambda: chars.capitalize(F.col("word")), f"{sq.upper('substr(word, 1, 1)')} || lower(substr(word, 2))")
_word_query("half_upper", lambda: chars.half_upper(F.col("word")), sq.half_upper("word"))
_word_query("ordinal_of_length", lambda: chars.ordinal(F.length(F.col("word"))), "length(word)::VARCHAR || CASE length(word) WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END")
_word_query("stress_class_by_mark", lambda: syllables.stress_type(F.col("word")), f"CASE WHEN regexp_matches(word, '[{chars.ACUTE}]') THEN 'mabilis' WHEN regexp_matches(word, '[{chars.GRAVE}]') THEN 'malumi' WHEN regexp_matches(word, '[{chars.CIRCUMFLEX}]') THEN 'maragsa' ELSE 'malumay' END")
_word_query("seeded_number", lambda: chars.number(7, F.col("word")), number_sql("'7|' || word"))
_word_query("random_char", lambda: chars.random_char(F.col("word"), 3), f"substr(word, ({number_sql(chr(39) + '3|' + chr(39) + ' || word')} % length(word) + 1)::INT, 1)")
_word_query("char_tokens_word", lambda: F.array_join(tokens.char_tokens(F.col("word")), ","), "array_to_string(list_transform(string_split(word, ''), lambda c: CASE WHEN ascii(c) < 128 THEN ascii(c) ELSE 0 END), ',')")
_word_query(
    "duplicate_pair_split",
    lambda: F.array_join(tokens.split_repeated_pair(F.col("word")), "|"),
    """(SELECT CASE WHEN i IS NULL THEN word ELSE concat_ws('|', nullif(substr(word, 1, i - 1), ''), substr(word, i, 2), nullif(substr(word, i + 2), '')) END
        FROM (SELECT list_min(list_filter(range(1, length(word) - 2), lambda i: substr(word, i, 2) = substr(word, i + 2, 2))) AS i))""",
)


@query(f"SELECT word FROM {WORDS_SQL} WHERE length(word) >= 5")
def length_filter(spark, sf_dir):
    return words(spark, sf_dir).where(F.length("word") >= 5)


@query(f"SELECT word FROM {WORDS_SQL} WHERE contains(word, 'ng')")
def ng_filter(spark, sf_dir):
    return words(spark, sf_dir).where(chars.contains_ng(F.col("word")))


@query(f"SELECT word FROM {WORDS_SQL} WHERE regexp_matches(word, '[{chars.VOWELS}]')")
def vowel_filter(spark, sf_dir):
    return words(spark, sf_dir).where(chars.has_vowel(F.col("word")))


@query("""SELECT doc_id, len(list_filter(string_split_regex(trim(line), '\\s+'), lambda x: x <> '')) = 1 AS single, NOT (starts_with(line, '-') OR ends_with(line, '-')) AS no_edge_hyphen
    FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)""")
def first_line_predicates(spark, sf_dir):
    from .base import table

    line = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select("doc_id", chars.is_single_word(line).alias("single"), chars.no_edge_hyphen(line).alias("no_edge_hyphen"))


@query("""SELECT w AS word, len(regexp_extract_all(w, '\\p{Lu}'))::BIGINT AS n_upper, len(regexp_extract_all(w, '\\p{Ll}'))::BIGINT AS n_lower
    FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS w FROM documents)""")
def case_counts(spark, sf_dir):
    w = F.col("w")
    return raw_words(spark, sf_dir).select("w").distinct().select(w.alias("word"), chars.count_upper(w).cast("bigint").alias("n_upper"), chars.count_lower(w).cast("bigint").alias("n_lower"))


@query(f"SELECT w AS word, {sq.upper('w')} AS up, lower(w) AS low FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS w FROM documents)")
def case_variants(spark, sf_dir):
    w = F.col("w")
    return raw_words(spark, sf_dir).select("w").distinct().select(w.alias("word"), F.upper(w).alias("up"), F.lower(w).alias("low"))


@query(f"SELECT word, array_to_string(syl, '-') AS syllables FROM {sq.SYLLABLES}")
def syllabify_words(spark, sf_dir):
    return words(spark, sf_dir).select("word", F.array_join(syllables.syllabify(F.col("word")), "-").alias("syllables"))


@query(f"SELECT len(syl)::INT AS n_syllables, count(*) AS n_words FROM {sq.SYLLABLES} GROUP BY 1")
def syllable_counts(spark, sf_dir):
    each = words(spark, sf_dir).select(F.size(syllables.syllabify(F.col("word"))).alias("n_syllables"))
    return each.groupBy("n_syllables").agg(F.count("*").alias("n_words"))


@query(f"SELECT word, {sq.reduplicated_syllable('syl')} AS syllable FROM {sq.SYLLABLES} WHERE {sq.reduplicated('syl')}")
def reduplicated_words(spark, sf_dir):
    each = words(spark, sf_dir).withColumn("s", syllables.syllabify(F.col("word"))).where(syllables.is_reduplicated(F.col("s")))
    return each.select("word", syllables.reduplicated_syllable(F.col("s")).alias("syllable"))


@query(f"SELECT word, strip_accents(word) AS result FROM {WORDS_SQL}")
def normalize_nfd(spark, sf_dir):
    return words(spark, sf_dir).select("word", chars.normalize_text_nfd(F.col("word")).alias("result"))


@query(f"SELECT word, array_to_string({sq.perturbations('word', 11)}, '|') AS perturbations FROM {WORDS_SQL}")
def perturbed_spellings(spark, sf_dir):
    return words(spark, sf_dir).select("word", F.array_join(chars.perturbations(F.col("word"), 11), "|").alias("perturbations"))


@query(f"SELECT word, {sq.diacritized('word', 5)} AS marked, {sq.diacritized('word', 6, 0.5)} AS half_marked, {sq.random_case('word', 7)} AS mixed_case FROM {WORDS_SQL}")
def diacritized_words(spark, sf_dir):
    return words(spark, sf_dir).select("word", chars.diacritize(F.col("word"), 5).alias("marked"), chars.diacritize(F.col("word"), 6, 0.5).alias("half_marked"), chars.random_case(F.col("word"), 7).alias("mixed_case"))
