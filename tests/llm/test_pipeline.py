"""The pipeline's stages against what each must keep, drop and change."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from talata.llm import decontaminate, langid, surrogates
from test_whole import similar_roots


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    told = corpus_pipeline.identify_language(spark, docs, data).cache()
    assert told.columns == columns and told.count() >= 0.95 * docs.count()
    found = langid.identify(docs, langid.learn(langid.learnable(docs))).where(f"lang_pred <> 'und' AND margin >= {langid.MIN_MARGIN}")
    assert {r.doc_id for r in told.collect()} == {r.doc_id for r in found.collect()}
    one = corpus_pipeline.drop_near_duplicates(spark, told, data).cache()
    rows = told.orderBy("doc_id").collect()
    kept = {rows[i].doc_id for i in set(similar_roots([r.text for r in rows]))}
    assert one.columns == columns and {r.doc_id for r in one.select("doc_id").collect()} == kept and len(kept) < len(rows)
    clean = corpus_pipeline.drop_contaminated(spark, one, data).cache()
    bad = {r.doc_id for r in decontaminate.contaminated(one, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - bad
    private = corpus_pipeline.replace_personal_data(spark, clean, data).cache()
    assert private.columns == columns and private.count() == clean.count() and private.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.pack_sequences(spark, private, data).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in private.collect()}
    whole = corpus_pipeline.run(spark, data).toPandas()
    key = ["doc_id", "piece"]
    assert whole.sort_values(key)[[*key, "ids_crc32"]].values.tolist() == packed.sort_values(key)[[*key, "ids_crc32"]].values.tolist()


TALK = "the quick brown fox jumps over the lazy dog and then it sleeps under a tree for hours while birds sing above number "


@pytest.fixture(scope="module")
def odd(spark, data):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    names = ["row", "id", "doc", "key", "rank", "print", "node", "score", "margin", "made", "kind", "hash", "size", "_rank", "_id"]
    rows = [
        (1, TALK * 3 + "one", "en"), (2, TALK * 3 + "one", "en"), (3, None, None), (4, "", "en"), (5, "   ", "en"), (6, "12345 !!", None), (7, (TALK + "seven ") * 4000, "en"), (8, "please write or call +1 (744) 555-2801 about the meeting of the garden club next monday evening at seven", None),
        (9, "la casa es muy grande y el perro duerme en la cocina con los gatos de la vecina que canta todo el dia", "es"), (9, "la casa es muy grande y el perro duerme en la cocina con los gatos de la vecina que canta todo el dia", "es"),
        (None, "ein hund und eine katze liegen auf dem alten sofa und schlafen bis zum abend unter der warmen decke", "de"), (None, TALK * 3 + "one", None),
    ]
    made = spark.createDataFrame([(*r, None, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    return made.withColumns({n: F.lit(f"{n}-value") for n in names})


def test_stages_on_odd_rows(spark, data, odd):
    learned = langid.learn(langid.learnable(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))))
    told = langid.accepted(odd, learned)
    assert told.columns == odd.columns and told.where("text IS NULL OR NOT text RLIKE '[a-z]'").count() == 0
    every = sorted(map(str, odd.collect()))
    one = corpus_pipeline.drop_near_duplicates(spark, odd, data)
    ids = sorted((r.doc_id or 0) for r in one.collect())
    # One of 1 and 2, of the blank ones, and of the repeated 9; the row without an id that is like 1 goes, the other stays.
    assert one.columns == odd.columns and ids == [0, 1, 3, 6, 7, 8, 9] and set(map(str, one.collect())) <= set(every)
    clean = corpus_pipeline.drop_contaminated(spark, odd, data)
    assert clean.columns == odd.columns and sorted(map(str, clean.collect())) == every
    private = corpus_pipeline.replace_personal_data(spark, odd, data)
    assert private.columns == odd.columns and private.count() == odd.count()
    assert [r.doc_id for r in private.collect() if r.doc_id == 8 and "744" not in r.text] == [8]
    assert sorted(map(str, private.where("doc_id IS NULL OR doc_id <> 8").collect())) == sorted(map(str, odd.where("doc_id IS NULL OR doc_id <> 8").collect()))
    packed = corpus_pipeline.pack_sequences(spark, odd, data)
    assert packed.where("piece = 0").count() == odd.count()


def test_stages_on_an_empty_table(spark, data, odd):
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, data)
        assert made.columns == docs.columns and made.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == 0


def test_the_key_is_a_setting(spark, data, odd):
    before = corpus_pipeline.replace_personal_data(spark, odd, data).where("doc_id = 8").first().text
    spark.conf.set(corpus_pipeline.KEY_SETTING, "a secret of its own")
    try:
        after = corpus_pipeline.replace_personal_data(spark, odd, data).where("doc_id = 8").first().text
    finally:
        spark.conf.unset(corpus_pipeline.KEY_SETTING)
    assert before != after and before == surrogates.replace_entities(odd, surrogates.TEST_KEY).where("doc_id = 8").first().text


def test_a_run_goes_on_after_the_last_whole_stage(spark, data, tmp_path, monkeypatch):
    folder, ran = f"file://{tmp_path}/stages", []
    counted = [(n, lambda *a, n=n, f=f: ran.append(n) or f(*a)) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", counted)
    first = sorted(map(str, corpus_pipeline.run(spark, data, folder).select("doc_id", "piece", "ids_crc32").collect()))
    assert ran == [n for n, _ in counted] and ran.clear() is None
    (done,) = (tmp_path / "stages").glob("*/3-personal_data/_SUCCESS")
    done.unlink()
    again = sorted(map(str, corpus_pipeline.run(spark, data, folder).select("doc_id", "piece", "ids_crc32").collect()))
    assert ran == ["personal_data", "packing"] and again == first and ran.clear() is None
    # Another key, and other input files, are another run.
    docs, benchmark = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    known = corpus_pipeline.fingerprint(spark, docs, benchmark)
    assert known == corpus_pipeline.fingerprint(spark, docs, benchmark) != corpus_pipeline.fingerprint(spark, docs)
    spark.conf.set(corpus_pipeline.KEY_SETTING, "a secret of its own")
    try:
        assert corpus_pipeline.fingerprint(spark, docs, benchmark) != known
    finally:
        spark.conf.unset(corpus_pipeline.KEY_SETTING)
