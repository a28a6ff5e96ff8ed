"""The affixation queries make items of every annotated word."""

import pytest

from talata.queries import generated


@pytest.mark.parametrize("run", [generated.affixation_mcq, generated.affixation_gen])
def test_every_annotated_word_has_its_items(spark, data, run):
    words = {r.word for r in generated._annotated(spark, data).select("word").collect()}
    made = run(spark, data).select("subcategory", "key", "answer").collect()
    inflected = [r.key for r in made if r.subcategory.startswith("inflection_")]
    named = [r.key for r in made if r.subcategory.startswith("identification_")]
    assert len(words) > 200 and set(inflected) == set(named) == words and len(inflected) == len(named) == len(words)
