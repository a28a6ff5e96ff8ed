"""Readers, writers and benchmark loaders: the test tables written in each format and read again.

Every query writes whole tables to the working folder through a sink or Spark's writer, reads them
through the operator it is named after, and has the SQL of what must come back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chars, syllables, tokens
from ..operators import information, vocabulary
from ..plans import lexicon as lexicons
from ..plans import tasks
from ..sources import loaders, readers, schemas, sinks
from ..working import new_path
from . import sqltext as sq
from . import task_sql
from .base import WORDS_SQL, query, raw_words, table, words
from .generated import _annotated, _written
from .vocab import AFFIXES, LIST, _affixes, _vocab
from .vocab import VOCAB_SQL

# --- scans and lists -------------------------------------------------------------------------


@query("SELECT md5(text) AS digest, length(text) AS n_chars FROM documents WHERE length(text) > 0")
def corpus_file(spark, sf_dir):
    """JSON lines of all texts, empty ones and lines that do not parse among them, by the reader that leaves these out."""
    path = new_path(spark, "corpus")
    docs = table(spark, sf_dir, "documents").select("text")
    sinks.write_jsonl(docs, path)
    docs.limit(0).unionByName(spark.createDataFrame([("",)], "text STRING")).write.mode("append").json(path)
    spark.createDataFrame([("not json",), ('{"text": ',)], "value STRING").write.mode("append").text(path)
    return readers.corpus(spark, path).select(F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT * FROM (VALUES ('not json'), ('{\"text\": ')) t(line)")
def bad_lines(spark, sf_dir):
    path = new_path(spark, "corpus")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("text"), path)
    spark.createDataFrame([("not json",), ('{"text": ',)], "value STRING").write.mode("append").text(path)
    return readers.bad_lines(spark, path)


def _annotation_file(spark, sf_dir):
    path = new_path(spark, "annotations")
    kind = F.when(F.col("prefix").isNotNull(), "prefix").otherwise("suffix")
    rows = _annotated(spark, sf_dir).select("word", "root", F.coalesce("prefix", "suffix").alias("affix"), kind.alias("affix_type"), F.array("root").alias("morphemes"), F.lit("test").alias("source"))
    sinks.write_jsonl(rows.orderBy("word"), path)  # parts of ranges of words, which the reader takes in order
    return path


@query(f"SELECT word, root, affix, kind AS affix_type FROM {task_sql.ANNOTATED} ORDER BY word LIMIT 100")
def annotation_scan_first(spark, sf_dir):
    """The first lines of a file: the limit is the operator's."""
    return readers.annotations(spark, _annotation_file(spark, sf_dir), 100).select("word", "root", "affix", "affix_type")


@query(f"SELECT word, root, affix, kind AS affix_type, root AS morphemes FROM {task_sql.ANNOTATED}")
def annotation_scan(spark, sf_dir):
    return readers.annotations(spark, _annotation_file(spark, sf_dir)).select("word", "root", "affix", "affix_type", F.array_join("morphemes", "|").alias("morphemes"))


@query(f"""SELECT word, NULLIF(CASE WHEN kind = 'prefix' THEN affix ELSE '' END, '') AS prefix, NULLIF(CASE WHEN kind = 'suffix' THEN affix ELSE '' END, '') AS suffix FROM {task_sql.ANNOTATED}""")
def wide_affixes(spark, sf_dir):
    return lexicons.wide_affixes(readers.annotations(spark, _annotation_file(spark, sf_dir))).select("word", "prefix", "suffix")


@query("SELECT d.doc_id::VARCHAR AS id, d.lang AS ground_truth, l.quality = 1 AS is_correct FROM documents d JOIN labels l USING (doc_id)")
def inference_scan(spark, sf_dir):
    """Result lines of a model, with the schema of multiple-choice results."""
    path = new_path(spark, "inference")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    sinks.write_jsonl(rows.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("ground_truth"), (F.col("quality") == 1).alias("is_correct"), F.array(F.lit(-0.5)).alias("logprobs")), path)
    return readers.jsonl(spark, path, schemas.MCQ_RESULT).select("id", "ground_truth", "is_correct")


def _result_folders(spark):
    """Folders of two models with an older and a newer document each, and one that is passed over."""
    path = new_path(spark, "results")
    for moment in ("old", "new"):
        for model in ("one", "two", "benchmark_evaluation"):
            spark.createDataFrame([(model, moment)], "hf_model_name STRING, timestamp STRING").coalesce(1).write.mode("append").json(f"{path}/{model}")
    return path


@query("SELECT * FROM (VALUES ('one', 'new'), ('two', 'new')) t(model, timestamp)")
def newest_per_model(spark, sf_dir):
    return readers.newest_per_model(spark, f"{_result_folders(spark)}/*/*.json", schemas.SUMMARY).select("model", "timestamp")


@query("SELECT 'new' AS timestamp")
def newest_file(spark, sf_dir):
    return readers.newest_file(spark, f"{_result_folders(spark)}/one/*.json", schemas.SUMMARY).select("timestamp")


@query(f"SELECT word, length(word) % 4 AS part FROM {WORDS_SQL}")
def lexicon_files(spark, sf_dir):
    """A lexicon over several files, read by a list of paths."""
    path = new_path(spark, "lexicon")
    rows = words(spark, sf_dir).withColumn("part", F.length("word") % 4)
    rows.select("word", "part", F.col("part").alias("p")).write.partitionBy("p").json(path)
    return readers.jsonl(spark, [f"{path}/p={i}" for i in range(4)], "word STRING, part BIGINT")


@query("SELECT w AS normalized, row_number() OVER (ORDER BY n DESC, w)::INT AS rank FROM (SELECT lower(w) AS w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS w FROM documents) GROUP BY 1)")
def frequency_file(spark, sf_dir):
    from ..operators import sampling

    path = new_path(spark, "frequencies")
    sampling.frequency_ranks(raw_words(spark, sf_dir).select(F.lower("w").alias("w")), "w").select("normalized", "rank").write.option("header", True).csv(path)
    return readers.frequencies(spark, path).select("normalized", "rank")


def _hyphened() -> list[tuple[str]]:
    return [(f"{a}-",) for a in AFFIXES] + [("",), ("   ",)]


@query(f"SELECT affix || '-' AS affix, 'prefix' AS affix_type FROM {LIST} UNION ALL SELECT affix, 'suffix' FROM {LIST} UNION ALL SELECT unnest({readers.DEFAULT_AFFIXES}), 'default'")
def affix_files(spark, sf_dir):
    path = new_path(spark, "affixes")
    spark.createDataFrame(_hyphened(), "value STRING").write.text(path)
    lists = readers.affix_list(spark, path, "prefix").unionByName(readers.affix_list(spark, path, "suffix", keep_hyphens=False))
    return lists.unionByName(readers.default_affixes(spark).withColumn("affix_type", F.lit("default")))


@query(f"SELECT word FROM {WORDS_SQL}")
def word_list_file(spark, sf_dir):
    path = new_path(spark, "words")
    each = words(spark, sf_dir)
    each.select(F.concat(F.lit(" "), "word").alias("value")).unionByName(spark.createDataFrame([("",)], "value STRING")).write.text(path)
    return readers.word_list(spark, path, each.count())


@query(f"SELECT id AS token_id, word FROM {VOCAB_SQL}")
def vocabulary_file(spark, sf_dir):
    path = new_path(spark, "vocabulary")
    _vocab(spark, sf_dir).write.parquet(path)
    return readers.vocabulary(spark, path).select("token_id", F.decode("token", "UTF-8").alias("word"))


@query(f"SELECT id AS token_id, word FROM {VOCAB_SQL}")
def ranked_vocabulary_file(spark, sf_dir):
    """Lines of a token in base64 and its rank."""
    path = new_path(spark, "ranks")
    _vocab(spark, sf_dir).select(F.concat_ws(" ", F.base64("token"), F.col("token_id").cast("string")).alias("value")).write.text(path)
    return readers.bpe_vocabulary(spark, path).select("token_id", F.decode("token", "UTF-8").alias("word"))


def _workbook(rows: list[list[str]]) -> bytes:
    """A small .xlsx file: numbers as numbers, the first column's texts inline, the others shared."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    shared: list[str] = []

    def cell(i: int, j: int, value: str) -> str:
        place = f"{chr(65 + j)}{i + 1}"
        if value.isdigit():
            return f'<c r="{place}"><v>{value}</v></c>'
        if not j:
            return f'<c r="{place}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        shared.append(value)
        return f'<c r="{place}" t="s"><v>{len(shared) - 1}</v></c>'

    sheet = "".join(f"<row>{''.join(cell(i, j, v) for j, v in enumerate(r) if v)}</row>" for i, r in enumerate(rows))
    out, space = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>{''.join(f'<si><t>{escape(x)}</t></si>' for x in shared)}</sst>")
    return out.getvalue()


@query("SELECT n_name AS name, n_nationkey::VARCHAR AS number, NULLIF(CASE WHEN n_regionkey = 1 THEN '' ELSE n_name || ' & <' || n_regionkey || '>' END, '') AS note FROM nation")
def spreadsheet_scan(spark, sf_dir):
    """A spreadsheet of the nations, with empty cells and marks that its format escapes."""
    from pyarrow import fs

    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    folder = new_path(spark, "sheets")
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/nations.xlsx") as f:
        f.write(_workbook([["name", "number", "note"], *[[r.n_name, str(r.n_nationkey), "" if r.n_regionkey == 1 else f"{r.n_name} & <{r.n_regionkey}>"] for r in nations]]))
    return readers.spreadsheet(spark, folder)


# --- binary ids, caches and chunks -----------------------------------------------------------

CODES = "list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE WHEN ascii(c) < 128 THEN ascii(c) ELSE 0 END)"


@query(f"SELECT count(*) AS n_ids, sum(x)::BIGINT AS total, sum(x * (r % 1000))::BIGINT AS weighted FROM (SELECT x, row_number() OVER (ORDER BY item_id, i) - 1 AS r FROM (SELECT item_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM (SELECT item_id, {CODES} AS c FROM benchmark)))")
def flat_ids(spark, sf_dir):
    """Ids of all items as one flat array of binary parts; its order is kept."""
    from ..operators.ordering import with_row_index

    ids = table(spark, sf_dir, "benchmark").select("item_id", tokens.char_tokens(F.col("text")).alias("ids"))
    meta = sinks.write_ids(ids, new_path(spark, "flat"), "ids", "item_id")
    back = with_row_index(sinks.read_ids(spark, meta["parts"]).select("part", "row", F.get("ids", F.lit(0)).alias("x")), "part", "row")
    return back.agg(F.count("*").alias("n_ids"), F.sum("x").alias("total"), F.sum(F.col("x") * (F.col("row_index") % 1000)).alias("weighted"))


@query(f"SELECT (row_number() OVER (ORDER BY item_id) - 1) AS position, list_sum(c)::BIGINT AS total, (SELECT max(len({CODES})) FROM benchmark)::INT AS width FROM (SELECT item_id, {CODES} AS c FROM benchmark)")
def padded_ids(spark, sf_dir):
    """A matrix of padded rows, by the shape in its metadata."""
    from ..operators.ordering import with_row_index

    ids = table(spark, sf_dir, "benchmark").select("item_id", tokens.char_tokens(F.col("text")).alias("ids"))
    meta = sinks.write_padded(ids, new_path(spark, "padded"), "ids", "item_id")
    back = with_row_index(sinks.read_ids(spark, meta["parts"], width=meta["shape"][1]), "part", "row", name="position")
    return back.select("position", F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.lit(meta["shape"][1]).alias("width"))


@query("SELECT item_id, length(text)::INT AS n_ids FROM benchmark")
def tokenized_file(spark, sf_dir):
    path = new_path(spark, "tokenized")
    sinks.write_unless_there(table(spark, sf_dir, "benchmark").select("item_id", tokens.char_tokens(F.col("text")).alias("ids")), path)
    return readers.tokenized(spark, path).select("item_id", F.size("ids").alias("n_ids"))


@query(f'SELECT merged, count(*) AS n FROM (SELECT t.id AS merged FROM (SELECT id, word, unnest(range(1, length(word))) AS i FROM {VOCAB_SQL}) t JOIN {VOCAB_SQL} l ON l.word = substr(t.word, 1, t.i) JOIN {VOCAB_SQL} r ON r.word = substr(t.word, t.i + 1)) GROUP BY merged')
def merge_cache(spark, sf_dir):
    """Pairs of a vocabulary that are built on first use and read on the second."""
    path = new_path(spark, "merges")
    made = sinks.load_or_build(spark, path, lambda: vocabulary.contractions(_vocab(spark, sf_dir)))
    again = sinks.load_or_build(spark, path, lambda: made.limit(0))
    return again.groupBy("merged").agg(F.count("*").alias("n"))


@query("SELECT doc_id % 7 AS chunk, length(text) AS n_chars, md5(replace(text, chr(10), ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def chunk_files(spark, sf_dir):
    """One folder of text for each chunk."""
    path = new_path(spark, "chunks")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("chunk_id", F.col("doc_id") % 7)
    sinks.write_chunks(docs, path, F.to_json(F.struct("text")))
    folders = [f"{path}/chunk_id={i}" for i in range(7)]
    parts = [spark.read.text(f).select(F.lit(i).cast("bigint").alias("chunk"), F.from_json("value", "text STRING")["text"].alias("text")) for i, f in enumerate(folders) if sinks.exists(spark, f)]
    return tasks.union(parts).select("chunk", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.replace("text", F.lit("\n"), F.lit(" ")).cast("binary")).alias("digest"))


@query("SELECT * FROM (VALUES (true, true), (false, false)) t(complete, has_bytes)")
def indexed_pairs(spark, sf_dir):
    """Whether the .bin and .idx of each expected prefix are there."""
    ids = table(spark, sf_dir, "benchmark").select("item_id", tokens.char_tokens(F.col("text")).alias("ids"))
    folder = new_path(spark, "pairs")
    names = [p.rsplit("/", 1)[1] for p in sinks.write_indexed(ids, folder, "ids", "item_id")]
    found = readers.prefix_pairs(spark, f"{folder}/*", [*names, "missing"])
    return found.select("complete", (F.col("bytes") > 0).alias("has_bytes")).distinct()


@query("SELECT * FROM (VALUES ('base', 'm/base', 'pt'), ('chat', 'm/chat', 'it')) t(name, path, type)")
def model_configs(spark, sf_dir):
    return readers.model_configs(spark, {"chat": {"path": "m/chat", "type": "it"}, "base": {"path": "m/base"}})


# --- benchmark loaders -----------------------------------------------------------------------

#: An item's words as four options; the right one stands at item_id % 4.
W = "string_split_regex(text, '\\s+')"


def _items(spark, sf_dir):
    w = F.split("text", r"\s+")
    pick = lambda i: F.concat(F.lit(f"{i}:"), F.get(w, F.lit(i)))
    options = F.array(*[pick(i) for i in range(4)])
    at = (F.col("item_id") % 4).cast("int")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", options.alias("o"), at.alias("at"), F.get(options, at).alias("right"), F.filter(options, lambda x: x != F.get(options, at)).alias("wrong"))


ITEMS = f"""(SELECT item_id::VARCHAR AS id, text, o, (item_id % 4)::INT AS at_, o[item_id % 4 + 1] AS right_, list_filter(o, lambda x: x <> o[item_id % 4 + 1]) AS wrong
    FROM (SELECT item_id, text, list_transform([0, 1, 2, 3], lambda i: i || ':' || {W}[i + 1]) AS o FROM benchmark))"""


def _loaded(name: str, rows, sql: str, **options):
    """Register a loader's query: ``rows`` makes its file's rows from the items, ``sql`` what it gives."""

    def run(spark, sf_dir):
        path = new_path(spark, name)
        sinks.write_jsonl(rows(_items(spark, sf_dir)), path)
        made = loaders.load_benchmark(spark, name, path, **options)
        return made.select("sample_id", "prefix", "ground_truth", F.array_join(F.array_sort("false_options"), "|").alias("false_options"))

    run.__name__ = f"load_{name.replace('-', '_')}"
    query(sql)(run)


def _sql(prefix: str, truth: str, false: str, sample_id: str = "id", where: str = "true") -> str:
    joined = f"array_to_string(list_sort({false}), '|')" if false else "''"
    return f"SELECT {sample_id} AS sample_id, {prefix} AS prefix, {truth} AS ground_truth, {joined} AS false_options FROM {ITEMS} WHERE {where}"


def _first_right():
    return F.concat(F.array("right"), F.col("wrong"))


def _wrong(i: int):
    return F.get("wrong", F.lit(i))


_loaded("hierarchical-mcq", lambda d: d.select("id", F.col("text").alias("prompt_tl"), F.col("right").alias("answer"), F.col("o").alias("options")), _sql("text", "right_", "wrong"))
_loaded("hierarchical-gen", lambda d: d.select("id", F.col("text").alias("question"), F.col("right").alias("answer")), _sql("text", "right_", ""))
_loaded("langgame-mcq", lambda d: d.select("id", F.col("text").alias("question"), F.col("right").alias("answer"), _first_right().alias("options")), _sql("text", "right_", "wrong"))
_loaded("langgame-gen", lambda d: d.select("id", F.col("text").alias("question"), F.col("right").alias("answer")), _sql("text", "right_", ""))
_loaded("multi-digit-addition-mcq", lambda d: d.select("id", F.col("text").alias("question"), F.col("right").alias("answer"), _first_right().alias("options")), _sql("text", "right_", "wrong"))
_loaded("multi-digit-addition", lambda d: d.select("id", F.col("text").alias("question"), F.col("right").alias("answer")), _sql("text", "right_", ""))
_loaded("cute", lambda d: d.select("id", F.col("text").alias("question"), F.col("right").alias("answer"), F.when(F.col("at") == 0, "other").otherwise("spell").alias("task_type")), _sql("text", "right_", "", where="at_ <> 0"))
_loaded(
    "arc",
    lambda d: d.select("id", F.col("text").alias("question"), F.struct(F.col("o").alias("text"), F.array(*map(F.lit, "ABCD")).alias("label")).alias("choices"), F.substr(F.lit("ABCD"), F.col("at") + 1, F.lit(1)).alias("answerKey")),
    _sql("'Question: ' || text || chr(10) || 'Answer:'", "right_", "wrong"),
)
_loaded("hellaswag", lambda d: d.select("id", F.col("text").alias("ctx"), F.col("o").alias("endings"), F.col("at").cast("string").alias("label")), _sql("text", "right_", "wrong"))
_shown = "('Options: ' || array_to_string(o, ';') || chr(10) || ' Answer: ')"
_loaded("mmlu", lambda d: d.select("id", F.col("text").alias("question"), F.col("o").alias("choices"), F.col("at").alias("answer")), _sql("text", f"{_shown} || right_", f"list_transform(wrong, lambda x: {_shown} || x)"))
_loaded(
    "winogrande",
    lambda d: d.select("id", F.concat(F.lit("a _ b "), "id").alias("sentence"), F.col("right").alias("option1"), _wrong(0).alias("option2"), F.when(F.col("at") < 2, "1").otherwise("2").alias("answer")),
    _sql("''", "'a ' || CASE WHEN at_ < 2 THEN right_ ELSE wrong[1] END || ' b ' || id", "['a ' || CASE WHEN at_ < 2 THEN wrong[1] ELSE right_ END || ' b ' || id]"),
)
_loaded(
    "blimp",
    lambda d: d.orderBy(F.col("id").cast("int")).select("id", F.col("right").alias("sentence_good"), _wrong(0).alias("sentence_bad")),
    f"SELECT id AS sample_id, '' AS prefix, right_ AS ground_truth, wrong[1] AS false_options FROM (SELECT *, row_number() OVER (ORDER BY id::INT) - 1 AS r, count(*) OVER () AS n FROM {ITEMS}) WHERE r >= floor(n * 0.6)",
)


@query(_sql("text", "right_", "wrong", where="at_ < 2"))
def load_nested_categories(spark, sf_dir):
    """Nested multiple-choice files by category."""
    folder = new_path(spark, "nested")
    options = F.struct(F.col("right").alias("correct"), *[_wrong(i).alias(f"incorrect{i + 1}") for i in range(3)])
    nested = F.array(F.struct(F.lit("q").alias("text_en"), F.col("text").alias("text_tl"), options.alias("mcq_options")))
    rows = _items(spark, sf_dir).select("id", F.when(F.col("at") < 2, "Composition").otherwise("Affixation").alias("category"), F.lit("s").alias("subcategory"), nested.alias("prompts"), F.lit("A").alias("label"))
    for name in ("Composition", "Affixation"):
        sinks.write_jsonl(rows.where(F.col("category") == name), f"{folder}/mcq_{name.lower()}.jsonl")
    made = loaders.load_benchmark(spark, next(n for n in loaders.LOADERS if n.endswith("-composition")), folder)
    return made.select("sample_id", "prefix", "ground_truth", F.array_join(F.array_sort("false_options"), "|").alias("false_options"))


# --- small functions without a query elsewhere -----------------------------------------------


@query(f"""SELECT word, contains(word, 'ST') OR contains(word, 'Tag') OR contains(word, 'none') AS filipino, len(list_filter(syl, lambda x: regexp_matches(x, '[{chars.ACCENTED_VOWELS}]'))) = 1 AS one_accent,
    regexp_full_match(upper(substr(word, 1, 1)), '[A-ZÑÀÁÂÈÉÊÌÍÎÒÓÔÙÚÛ]') AS upper_letter, regexp_matches(word, '[{chars.DIACRITICS}]') AS marked, word || '-' || word || '-' AS file, word AS same FROM {sq.SYLLABLES}""")
def word_predicates(spark, sf_dir):
    w = F.col("word")
    return words(spark, sf_dir).select(
        "word", chars.is_filipino(w).alias("filipino"), (syllables.count_accented(syllables.syllabify(w)) == 1).alias("one_accent"), chars.is_upper_letter(F.upper(F.substring(w, 1, 1))).alias("upper_letter"),
        chars.has_diacritic(w).alias("marked"), chars.file_name(F.concat(w, F.lit("/"), w, F.lit("\\"))).alias("file"), chars.same(w).alias("same"),
    )


@query(f"""SELECT word, concat_ws('|', substr(word, 1, 2), substr(word, 3, 2), nullif(substr(word, 5), '')) AS cut, substr(word, 1, 1) || 'xy' || substr(word, 4) AS spliced FROM {WORDS_SQL} WHERE length(word) >= 4""")
def cut_and_splice(spark, sf_dir):
    """Words cut at given boundaries, and a run of elements replaced by others."""
    w = F.col("word")
    bounds = F.array(F.lit(4), F.lit(2), F.lit(0), F.length(w))
    rows = words(spark, sf_dir).where(F.length(w) >= 4)
    return rows.select("word", F.array_join(tokens.cut_at(w, bounds), "|").alias("cut"), F.array_join(tokens.splice(chars.to_chars(w), F.lit(1), F.array(F.lit("x"), F.lit("y")), 2), "").alias("spliced"))


@query("SELECT item_id, 'q' || length(text) AS question, item_id::VARCHAR AS answer FROM benchmark")
def flat_questions(spark, sf_dir):
    """A flat stream of questions and answers, an unfinished one at its end, parsed into pairs."""
    stream = F.concat(F.lit("$q"), F.length("text").cast("string"), F.lit("="), F.col("item_id").cast("string"), F.lit("$unfinished"))
    qa = tokens.questions_and_answers(stream)
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(qa).alias("qa")).select("item_id", "qa.question", "qa.answer")


@query("SELECT item_id, array_to_string(list_transform(range(0, 6), lambda i: CASE WHEN i < 3 THEN (i >= item_id % 3)::INT ELSE (i >= 4)::INT END), '') AS mask, '100000110000111000000100000110000111' AS sees FROM benchmark")
def segment_masks(spark, sf_dir):
    """Loss masks from the start of each segment's answer, and who sees whom inside two segments."""
    segments = F.array(*[F.lit(i) for i in (0, 0, 0, 1, 1, 1)])
    starts = F.array((F.col("item_id") % 3).cast("int"), F.lit(4))
    sees = F.array_join(F.flatten(tokens.causal_block_mask(segments)).cast("array<string>"), "")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tokens.answer_mask(segments, starts).cast("array<string>"), "").alias("mask"), sees.alias("sees"))


@query(f"SELECT category, subcategory, text_tl AS question, answer FROM ({task_sql.manipulation('mcq')}) WHERE len(string_split(wrong, '|')) = 3")
def flat_generative(spark, sf_dir):
    """Multiple-choice tasks as flat items, and those without their options."""
    return tasks.to_generative(tasks.flat_mcq(tasks.manipulation(_written(spark, sf_dir), 20)))


@query(f"SELECT category, subcategory, text_en, answer AS label FROM ({task_sql.composition('gen')})")
def nested_generative(spark, sf_dir):
    made = tasks.gen_items(tasks.composition(_written(spark, sf_dir), 20, "gen"))
    return made.select("category", "subcategory", F.get("prompts", F.lit(0))["text_en"].alias("text_en"), "label")


@query("SELECT doc_id, lang, length(text) AS n FROM documents")
def json_round_trip(spark, sf_dir):
    """Rows as JSON text and back, with a nested path."""
    packed = F.to_json(F.struct(F.struct("lang", F.struct("text").alias("body")).alias("doc")))
    back = F.from_json(packed, "doc STRUCT<lang: STRING, body: STRUCT<text: STRING>>")
    return table(spark, sf_dir, "documents").select("doc_id", back["doc"]["lang"].alias("lang"), F.length(back["doc"]["body"]["text"]).cast("bigint").alias("n"))


def _h(sql: str) -> str:
    return f"(SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) FROM (SELECT count(*) AS n FROM ({sql}) GROUP BY v))"


def _information(name: str, tokens: str, pairs: str) -> str:
    """The terms of a tokenization: ``tokens`` (v) of all words, and ``pairs`` (m, v) of a morpheme and each token that it meets."""
    morphemes = f"SELECT unnest([root, affix]) AS v FROM {task_sql.ANNOTATED}"
    each = lambda of, other: f"(SELECT {of} AS k, abs(round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6)) AS h FROM (SELECT {of}, {other}, count(*) AS n FROM ({pairs}) GROUP BY ALL) GROUP BY ALL)"
    given = lambda of, other, all_: f"(SELECT round(sum(n * h) / sum(n), 6) FROM (SELECT v AS k, count(*) AS n FROM ({all_}) GROUP BY ALL) JOIN {each(of, other)} USING (k))"
    return f"SELECT '{name}' AS tokenization, {_h(tokens)} AS te, {_h(morphemes)} AS me, {given('m', 'v', morphemes)} AS tm, {given('v', 'm', tokens)} AS mt"


LETTERS_OF = _information("letters", f"SELECT unnest(string_split(word, '')) AS v FROM {task_sql.ANNOTATED}", f"SELECT m, unnest(string_split(m, '')) AS v FROM (SELECT unnest([root, affix]) AS m FROM {task_sql.ANNOTATED})")
WORDS_OF = _information("words", f"SELECT word AS v FROM {task_sql.ANNOTATED}", f"SELECT unnest([root, affix]) AS m, word AS v FROM {task_sql.ANNOTATED}")


@query(f"""SELECT tokenization, round(te, 5) AS token_entropy, round(me, 5) AS morpheme_entropy, round(tm, 5) AS token_given_morpheme_entropy, round(mt, 5) AS morpheme_given_token_entropy,
    round(me - mt, 5) AS mutual_information FROM ({LETTERS_OF} UNION ALL {WORDS_OF})""")
def tokenization_information(spark, sf_dir):
    """Information content of two tokenizations of the same words."""
    rows = _annotated(spark, sf_dir)
    morphemes = F.when(F.col("prefix").isNotNull(), F.array("prefix", "root")).otherwise(F.array("root", "suffix"))
    made = information.compare_information({"letters": rows.select(morphemes.alias("morphemes"), chars.to_chars(F.col("word")).alias("tokens")), "words": rows.select(morphemes.alias("morphemes"), F.array("word").alias("tokens"))})
    terms = ("token_entropy", "morpheme_entropy", "token_given_morpheme_entropy", "morpheme_given_token_entropy", "mutual_information")
    return made.select("tokenization", *[F.round(c, 5).alias(c) for c in terms])


@query("SELECT subcategory, count(*) AS count FROM (SELECT lang AS subcategory FROM documents) GROUP BY 1")
def value_counts(spark, sf_dir):
    from ..operators import profiles

    return profiles.profile(table(spark, sf_dir, "documents").select(F.col("lang").alias("subcategory")), F.lit(True), "subcategory").select("subcategory", F.col("n_total").alias("count"))


@query(f"SELECT affix FROM {LIST}")
def affix_column(spark, sf_dir):
    return _affixes(spark).select("affix")
