"""Training files and generators: every query's SQL, file formats byte by byte, and exact rules."""

import glob
import json
import os
import struct


import numpy as np
import pytest
from pyspark.sql import functions as F

from talata import catalog, working
from talata.operators import expand, information, ordering, vocabulary
from talata.plans import lexicon, tasks
from talata.sources import loaders, sinks
from tests.test_queries import duck, rows  # noqa: F401


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


GENERATED = [
    "composition_mcq", "composition_gen", "manipulation_mcq", "manipulation_gen", "syllabification_mcq", "syllabification_gen", "stress_benchmark_mcq", "hierarchical_words_mcq",
    "hierarchical_words_gen", "hierarchical_affixes_mcq", "mcq_items", "group_of_four_characters", "addition_options", "langgame_most", "langgame_ends", "affixation_mcq", "affixation_gen", "annotation_table",
    "lexicon_build", "visualization_export", "syllabify_words", "reduplicated_words", "perturbed_spellings", "diacritized_words", "affix_decompositions_top3", "similar_affixes_topk", "stochastic_expand",
    "affix_contract_expand", "sample_with_replacement", "bpe_round_trip", "indexed_files", "stream_batches", "game_training", "sum_training", "sum_question_answers", "rank_means", "stamped_names", "infix_positions",
    "corpus_file", "bad_lines", "annotation_scan_first", "wide_affixes", "newest_per_model", "newest_file", "frequency_file", "affix_files", "ranked_vocabulary_file", "flat_ids", "padded_ids", "merge_cache", "chunk_files",
    "indexed_pairs", "load_hierarchical_mcq", "load_arc", "load_mmlu", "load_winogrande", "load_blimp", "load_cute", "load_nested_categories", "word_predicates", "cut_and_splice", "flat_questions", "segment_masks",
    "tokenization_information", "masked_loss", "capitalize_word", "case_variants", "contraction_table", "merged_encoding", "stochastic_contract", "affix_cycles", "expanded_batches", "converted_folder",
    "level_files", "combined_files", "csv_export", "run_summaries", "groups_in_rounds", "sql_choice_metrics", "sql_word_splits", "sql_windows", "mcq_metrics_by_label", "mcq_predictions", "mcq_outcome_summary",
    "validation_loss", "level_task_counts", "chunk_path_scan", "first_samples", "oversampled_scan", "homograph_sample",
]


@pytest.mark.parametrize("name", [n for n in GENERATED if n in catalog.QUERIES])
def test_generated_query_matches_sql(spark, data, duck, name):  # noqa: F811
    made, wanted = rows(catalog.QUERIES[name](spark, data).toPandas()), rows(duck.execute(catalog.ORACLES[name]).df())
    assert made[0] == wanted[0] and made[1].equals(wanted[1])


def test_an_idle_edit_fails(spark, data, duck, monkeypatch):  # noqa: F811
    for name in ("expand", "contract", "cycles", "contract_expand"):
        monkeypatch.setattr(expand, name, lambda ids, tables, draws, *a, **b: list(ids))
    for name in ("stochastic_expand", "stochastic_contract", "affix_cycles", "affix_contract_expand"):
        made, wanted = rows(catalog.QUERIES[name](spark, data).toPandas()), rows(duck.execute(catalog.ORACLES[name]).df())
        assert made[0] == wanted[0] and not made[1].equals(wanted[1]), name


def test_upper_case_kinds_have_tasks(spark, data):
    made = {r.subcategory: r["count"] for r in catalog.QUERIES["composition_mcq"](spark, data).groupBy("subcategory").count().collect()}
    assert len(made) == 9 and set(made.values()) == {20}
    assert catalog.QUERIES["composition_gen"](spark, data).where("subcategory = 'uppercase'").count() == 20


def test_rounds_go_on_until_there_are_enough(spark, data):
    from talata.queries.generated import _written

    words = _written(spark, data)
    one, more = (tasks.enough_groups(words, "diacritic", n).select("group_id", F.explode("words").alias("w")).toPandas() for n in (None, 100_000))
    assert len(more) > len(one) and more.w.is_unique and set(one.group_id) < set(more.group_id)
    n = one.group_id.nunique()
    assert tasks.enough_groups(words, "diacritic", n).count() == n  # no round more than needed
    assert tasks.enough_groups(words.limit(3), "length", 5).count() == 0


def test_distractors_are_three_and_wrong(spark, data):
    """Of every task with options: three of them, all different, none right."""
    made = [tasks.manipulation(_lexicon(spark, data), 200), tasks.composition(_lexicon(spark, data), 200), tasks.syllabification(_lexicon(spark, data), 200)]
    for df in made:
        odd = df.where((F.size("wrong") == 3) & F.array_contains("wrong", F.col("answer"))).where("subcategory NOT LIKE 'syllable_counting%'")
        assert odd.where("subcategory IN ('deletion', 'insertion', 'substitution', 'permutation', 'duplication', 'stress', 'length_exactly', 'character_most')").count() == 0


def _lexicon(spark, data):
    from talata.queries.generated import _lexicon as build

    return build(spark, data)


def test_indexed_files_byte_by_byte(spark):
    df = spark.createDataFrame([(3, [7, 8]), (1, [1, 2, 3]), (2, []), (4, None)], "id int, ids array<int>")
    folder = working.new_path(spark, "test-indexed")
    prefixes = sinks.write_indexed(df.coalesce(1), folder, "ids", "id", end_id=9)
    ids, sizes = [], []
    for p in [p.removeprefix("file://") for p in prefixes]:
        raw = open(f"{p}.idx", "rb").read()
        assert raw[:9] == b"MMIDIDX\0\0" and struct.unpack("<QB", raw[9:18]) == (1, 8)
        n, docs = struct.unpack("<QQ", raw[18:34])
        own = np.frombuffer(raw, "<i4", n, 34)
        assert docs == n + 1 and len(raw) == 34 + 4 * n + 8 * n + 8 * docs
        assert np.frombuffer(raw, "<i8", n, 34 + 4 * n).tolist() == (2 * (np.cumsum(own) - own)).tolist()
        assert np.frombuffer(raw, "<i8", docs, 34 + 12 * n).tolist() == list(range(docs))
        ids += np.fromfile(f"{p}.bin", "<u2").tolist()
        sizes += own.tolist()
    assert ids == [1, 2, 3, 9, 9, 7, 8, 9, 9] and sizes == [4, 1, 3, 1]
    assert [r.ids for r in sinks.read_indexed(spark, prefixes).orderBy("part", "row").collect()] == [[1, 2, 3, 9], [9], [7, 8, 9], [9]]
    with pytest.raises(Exception, match="do not fit"):
        sinks.write_indexed(spark.createDataFrame([(1, [70_000])], "id int, ids array<int>"), working.new_path(spark, "test-indexed"), "ids", "id")
    assert sinks.write_indexed(df.limit(0), working.new_path(spark, "test-indexed"), "ids", "id") == []


def test_streams_are_cut_and_expanded_by_batch(spark):
    words = [b"a", b"b", b"c", b"ab", b"abc", b"bc"]
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "token binary, token_id int")
    tables = expand.Tables.collect(vocabulary.expansions(vocab), vocab)
    df = spark.createDataFrame([(i, [4] * (i % 5)) for i in range(40)], "id int, ids array<int>").repartition(3)
    batches = ordering.stream_batches(df, "ids", "id", batch=16)
    cut = [r.ids for r in batches.orderBy("batch").collect()]
    assert [len(x) for x in cut] == [16] * 5 and sum(cut, []) == [4] * 80
    done = expand.expand_batches(spark, batches, tables, seed=3)
    made = [r.ids for r in done.orderBy("batch").collect()]
    assert [tables.decode(x) for x in made] == ["abc" * 16] * 5 and all(16 < len(x) <= 32 for x in made)
    assert made == [r.ids for r in expand.expand_batches(spark, batches.repartition(2), tables, seed=3).orderBy("batch").collect()]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(expand.Tables, "MOST", 3)
        with pytest.raises(ValueError, match="more than 3"):
            expand.Tables.collect(vocabulary.expansions(vocab), vocab)


def test_full_prefixes_leave_words_to_later_ones(spark):
    """Against taking the words in order, each to the first prefix that fits and has room."""
    names = sorted({a + b + c for a in ("ma", "mag", "magka", "pa", "na") for b in ("ab", "ka", "lo") for c in ("ta", "ngi", "s", "bat")})
    prefixes = ["ma", "magka", "pa", "mag", "na"]
    for most in (2, 5, 100):
        want, room = {}, dict.fromkeys(prefixes, most)
        for w in names:
            if len(w) >= 4:
                for p in prefixes:
                    if w.startswith(p) and len(w) - len(p) >= 2 and room[p]:
                        want[w] = p
                        room[p] -= 1
                        break
        lex = spark.createDataFrame([(w, [w]) for w in names], "normalized_word string, normalized_syllable_list array<string>")
        side = spark.createDataFrame([(p, i) for i, p in enumerate(prefixes)], "affix string, position int")
        made = {r.word: r.affix for r in lexicon.prefixed_words(lex, side, most).collect()}
        assert made == want, most


def test_folders_are_converted_file_by_file(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"question": "ab"}\n{"question": "c"}\n')
    (tmp_path / "two.jsonl").write_text('{"prompt": "xyz"}\n')
    (tmp_path / "large.jsonl").write_text('{"question": "\U0001f600"}\n')
    codes = lambda s: F.transform(F.split(s, ""), lambda c: F.ascii(c))
    made = sinks.convert_folder(spark, f"{tmp_path}/*.jsonl", f"file://{tmp_path}/out", codes)
    assert set(made) == {"one.jsonl", "two.jsonl", "large.jsonl"} and made["one.jsonl"]["n_ids"] == 3 and "ids do not fit" in made["large.jsonl"] or isinstance(made["large.jsonl"], str)
    assert b"".join(open(p.removeprefix("file://"), "rb").read() for p in made["one.jsonl"]["parts"]) == np.array([97, 98, 99], "<u2").tobytes()
    assert b"".join(open(p.removeprefix("file://"), "rb").read() for p in made["two.jsonl"]["parts"]) == np.array([120, 121, 122], "<u2").tobytes()
    assert sinks.convert_folder(spark, f"{tmp_path}/*.none", f"file://{tmp_path}/out", codes) == {}


def test_tasks_are_collected(spark, tmp_path):
    rows_ = [{"id": str(i), "question": f"q{i}", "answer": "a", "options": ["a", "b"]} for i in range(5)]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, rows_)))
    made = loaders.collect_tasks(spark, "langgame-val", str(tmp_path / "g.jsonl"), max_samples=3)
    assert len(made) == 3 and set(made[0]) == {"prefix", "ground_truth", "false_options"} and made[0]["ground_truth"] == "a"


def test_information_content_equals_plain_python(spark):
    import collections
    import math

    data = [(["un", "do"], ["u", "ndo"]), (["un", "tie"], ["unt", "ie"]), (["re", "do"], ["re", "do"])]

    def h(xs):
        c, n = collections.Counter(xs), len(xs)
        return -sum(v / n * math.log2(v / n) for v in c.values()) if xs else 0.0

    def spans(xs):
        at = 0
        for x in xs:
            yield x, at, at + len(x)
            at += len(x)

    pairs = [(m, t) for ms, ts in data for m, a, b in spans(ms) for t, c, d in spans(ts) if d > a and c < b]
    ms, ts = [m for x, _ in data for m in x], [t for _, x in data for t in x]
    given = lambda side, other, marginal: sum(n / len(marginal) * h([p[other] for p in pairs if p[side] == k]) for k, n in collections.Counter(marginal).items())
    made = information.information_content(spark.createDataFrame(data, "morphemes array<string>, tokens array<string>")).first()
    want = (h(ts), h(ms), given(0, 1, ms), given(1, 0, ts))
    assert [round(x, 5) for x in (made.token_entropy, made.morpheme_entropy, made.token_given_morpheme_entropy, made.morpheme_given_token_entropy)] == [round(x, 5) for x in want]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        working.shared_dir(Session())


def test_working_tables_can_be_dropped(spark):
    made = working.materialize(spark.range(5), "dropped")
    folder = made.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    assert glob.glob(f"{folder}/*.parquet")
    working.drop_table(made)
    assert not os.path.exists(folder)
    working.drop_table(None)
