"""Parts of operators that SQL can express, over the test tables in DuckDB; and rules against brute force."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from talata.llm import licenses, surrogates, urlgraph

SF = "/root/testdata/sf0.01"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_license_base_columns_equal_sql(spark):
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS spot, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) WHERE w[i:i + {len(phrase.split()) - 1}] = {phrase.split()}" for phrase, label in licenses.BASE.items()
    )
    sql = rf"""
WITH words AS (SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM '{SF}/documents.parquet'),
places AS ({phrases})
SELECT words.doc_id, len(w) AS n_words, count(spot) AS n_base, min(spot) AS first_word, max(spot) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM words LEFT JOIN places USING (doc_id) GROUP BY words.doc_id, len(w)"""
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    made = licenses.op10_license_rules(spark, SF).select(*columns)
    assert rows(made, columns) == sorted(duckdb.sql(sql).fetchall(), key=str)


def test_url_rules_equal_sql(spark):
    sql = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM '{SF}/pages.parquet'),
rules AS (SELECT unnest(['net/', 'example.net/en/', 'example.com/de/', 'org/fr/']) AS rule),
parts AS (SELECT rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM u JOIN parts ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, fits.rule FROM u LEFT JOIN fits USING (page_id)"""
    columns = ["page_id", "host", "path", "rule"]
    made = urlgraph.op6_link_graph(spark, SF)
    assert rows(made, columns) == sorted(duckdb.sql(sql).fetchall(), key=str)
    says = dict(urlgraph.RULES)
    assert all(r.verdict == says[r.rule] for r in made.where("rule IS NOT NULL").collect())


def test_untouched_documents_equal_sql(spark):
    """Texts without a digit, @, = or a title hold nothing that could be replaced, and stay as they are."""
    titles = surrogates._TITLE[3:-1].replace("Señora?", "Señor")
    sql = f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE NOT regexp_matches(text, '[0-9@=:]|{titles}') ORDER BY doc_id"
    want = duckdb.sql(sql).fetchall()
    made = surrogates.replace_entities(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), surrogates.TEST_KEY, details=True)
    kept = {r.doc_id: (r.text, r.n_entities) for r in made.collect()}
    assert len(want) > 300 and all(kept[i] == (t, 0) for i, t in want)


@pytest.mark.parametrize("seed", range(30))
def test_suppression_equals_brute_force(seed):
    """Random rules over a small alphabet: containment and ties as by comparing every pair."""
    rng = random.Random(seed)
    rules = [licenses.Rule(f"r{i}", "".join(rng.choice("abc.") for _ in range(rng.randint(1, 5))), rng.choice([1, 2, 2, 3]), 0.5, ()) for i in range(12)]
    text = "".join(rng.choice("abc") for _ in range(60))
    scanner = licenses.Scanner(rules, {})
    every = [(m.start(), m.end(), i) for i, c in enumerate(scanner.compiled) for m in c.finditer(text)]
    order = sorted(every, key=lambda x: (-rules[x[2]].priority, -(x[1] - x[0]), x[0], x[2]))
    kept = []
    for a, b, i in order:
        if not any(x <= a and b <= y for x, y, _ in kept):
            kept.append((a, b, i))
    assert scanner.detect(text) == [(a, b, rules[i]) for a, b, i in sorted(kept)]


def test_many_detections_in_one_text(spark):
    text = "mit license, apache license version 2.0, gnu general public license; " * 14_000
    began = time.time()
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), spans=True).select("n_base", "first_word", "last_word", F.size("detections").alias("n"), "labels").first()
    assert time.time() - began < 20 and (r.n_base, r.first_word, r.n) == (42_000, 0, 42_000) and r.last_word == 11 * 14_000 - 4


def test_rules_that_stand_alone():
    rules = licenses.build_rules()
    assert len(licenses.SIGNATURES) > 150 and all(r.keywords for r in rules)
    scanner = licenses.Scanner(rules)
    cases = {
        "you may not use this file except in compliance with the license": "apache-2.0",
        "the software shall be used for good, not evil": "json",
        "if a copy of the mpl was not distributed with this file": "mpl-2.0",
        "redistributions of source code must retain the above copyright notice": "bsd",
        "under the polyform noncommercial license 1.0.0": "polyform-nc",
        "open government licence v3.0": "ogl-uk",
    }
    for text, label in cases.items():
        assert label in {r.label for _, _, r in scanner.detect(text)}, text
