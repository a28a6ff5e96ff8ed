"""Schemas of the inputs, as DDL."""

CORPUS = "text STRING"
TOKENIZED = "ids ARRAY<INT>, len INT, split STRING"
LEXICON = (
    "word STRING, etymology STRING, part_of_speech STRING, word_sense STRING, accented_syllable_list ARRAY<STRING>, accented_syllable STRING, accented_syllable_index BIGINT,"
    " last_syllable STRING, last_syllable_index BIGINT, last_syllable_pronunciation STRING, normalized_word STRING, normalized_syllable_list ARRAY<STRING>"
)
FREQUENCIES = "normalized STRING, rank INT"
INFLECTIONS = "root STRING, affix_type STRING, prefix STRING, suffix STRING, infix STRING, correct STRING, incorrect1 STRING, incorrect2 STRING, incorrect3 STRING"
INFLECTED = "root STRING, inflected STRING, aspect_affix STRING, aspect STRING, focus STRING"
ANNOTATIONS = (
    "word STRING, root STRING, affix STRING, affix_type STRING, aspect STRING, focus STRING, morphemes ARRAY<STRING>, morpheme_types ARRAY<STRING>,"
    " boundaries ARRAY<INT>, infix_position INT, source STRING, syllables ARRAY<STRING>"
)
OPTIONS = "STRUCT<correct:STRING,incorrect1:STRING,incorrect2:STRING,incorrect3:STRING>"
MCQ_NESTED = f"category STRING, subcategory STRING, prompts ARRAY<STRUCT<text_en:STRING,text_tl:STRING,mcq_options:{OPTIONS},choice1:STRING,choice2:STRING,choice3:STRING,choice4:STRING>>, label STRING, id STRING"
GEN_NESTED = "category STRING, subcategory STRING, prompts ARRAY<STRUCT<text_en:STRING,text_tl:STRING>>, label STRING, id STRING"
FLAT = "id STRING, question STRING, answer STRING, options ARRAY<STRING>, task_type STRING"
HIERARCHICAL = "id STRING, level INT, category STRING, subcategory STRING, prompt_en STRING, prompt_tl STRING, question STRING, options ARRAY<STRING>, answer STRING, word STRING, metadata MAP<STRING,STRING>"
MCQ_RESULT = "id STRING, question STRING, ground_truth STRING, options ARRAY<STRING>, predicted_idx INT, predicted_answer STRING, is_correct BOOLEAN, logprobs ARRAY<DOUBLE>"
GEN_RESULT = "id STRING, question STRING, ground_truth STRING, generated STRING, exact_match BOOLEAN, contains_match BOOLEAN, prefix_match BOOLEAN"
PREDICTION = "level INT, category STRING, subcategory STRING, correct BOOLEAN, predicted_answer STRING, gold_answer STRING"
VOCABULARY = "token BINARY, token_id INT"
SUMMARY = "hf_model_name STRING, model_type STRING, benchmarks MAP<STRING,MAP<STRING,DOUBLE>>, timestamp STRING"
