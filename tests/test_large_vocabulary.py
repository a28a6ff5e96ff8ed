"""Token edits by vocabularies that are too large to be shared with every task."""

import pytest
from pyspark.sql import functions as F

from talata import catalog
from talata.operators import expand, vocabulary
from tests.test_queries import duck, rows  # noqa: F401

QUERIES = ["merged_encoding", "expanded_batches", "affix_contract_expand", "affix_cycles", "stochastic_contract", "stochastic_expand"]


@pytest.mark.parametrize("name", QUERIES)
def test_query_needs_no_shared_vocabulary(spark, data, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(expand.Tables, "MOST", 100)
    made, wanted = rows(catalog.QUERIES[name](spark, data).toPandas()), rows(duck.execute(catalog.ORACLES[name]).df())
    assert made[0] == wanted[0] and made[1].equals(wanted[1])


def test_joined_tables_do_as_shared_ones(spark):
    """Null, empty, equal and non-ASCII texts; an affix that is no token; tokens longer than any text."""
    words = sorted({bytes([i]) for i in range(256)} | {w.encode() for w in ("ab", "aba", "abab", "é", "éa", " a", "bé", "x" * 40)})
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "token binary, token_id int")
    versions = spark.createDataFrame([("ab",), ("baé",), ("é",)], "version string")
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "abababéa ab"), (4, "abababéa ab"), (None, "é 日本 baéab"), (6, "z")], "id int, text string")
    shared = expand.Tables.collect(vocabulary.expansions(vocab), vocab, versions)
    listed = expand.entries(vocab, versions)
    one = texts.select("id", "text", expand.text_encoder(spark, shared)(F.col("text")).alias("ids"))
    own = expand.with_known(texts, F.col("text"), listed).select("id", "text", "known", expand.known_encoder()(F.col("text"), F.col("known")).alias("ids"))
    for edit in (expand.expand, expand.contract, expand.cycles, expand.contract_expand):
        want = one.select("id", "ids", expand.per_row(spark, shared, edit, seed=7)(F.coalesce("id", F.lit(0)), F.col("ids")).alias("edited"))
        made = own.select("id", "ids", "known", expand.known_edit(edit, seed=7)(F.coalesce("id", F.lit(0)), F.col("ids"), F.col("known")).alias("edited"))
        key = lambda r: (r.id or 0, r.ids, r.edited)
        assert sorted(map(key, made.collect()), key=str) == sorted(map(key, want.collect()), key=str)
    back = own.select("text", expand.known_decoder()(F.col("ids"), F.col("known")).alias("back")).collect()
    assert len(back) == 6 and all(r.text == r.back for r in back)
    with pytest.raises(Exception, match="is no token"):
        odd = expand.with_known(texts, F.col("text"), listed.where("octet_length(token) > 1"))
        odd.select(expand.known_encoder()(F.col("text"), F.col("known"))).collect()
