"""Vocabulary queries: the vocabulary is the documents' frequent words and all letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expand, vocabulary
from . import task_sql
from .base import LETTERS, number_sql, query, raw_words, table

#: A few affixes that occur in the test texts.
AFFIXES = ["the", "on", "er", "in", "an", "re", "tion", "ing", "sh", "ha", "einver", "ciónta", "zzq"]
VOCAB_SQL = f"""(SELECT word, (row_number() OVER (ORDER BY word) - 1)::INT AS id FROM (
    SELECT word FROM (SELECT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '{LETTERS}')) AS w FROM documents)) GROUP BY word HAVING count(*) >= 3
    UNION SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', ''))))"""


def _vocab(spark, sf_dir):
    from ..operators.ordering import with_row_index

    often = raw_words(spark, sf_dir).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n")).where("n >= 3").select("word")
    letters = spark.range(26).select(F.char(97 + F.col("id")).alias("word"))
    numbered = with_row_index(often.unionByName(letters).distinct(), "word")
    return numbered.select(F.encode("word", "UTF-8").alias("token"), F.col("row_index").cast("int").alias("token_id"), "word")


def _affixes(spark):
    return spark.createDataFrame([(a, "prefix" if i % 3 == 0 else "infix" if i % 3 == 1 else "suffix") for i, a in enumerate(AFFIXES)], "affix STRING, affix_type STRING")


#: Tokens as hexadecimal bytes, so that they are cut at bytes and not at characters.
BYTES_VOCAB = f"(SELECT id, hex(encode(word)) AS h FROM {VOCAB_SQL})"
MERGES_SQL = f"""(SELECT t.id AS merged, l.id AS "left", r.id AS "right" FROM (SELECT id, h, unnest(range(1, length(h) // 2)) AS i FROM {BYTES_VOCAB}) t
    JOIN {BYTES_VOCAB} l ON l.h = substr(t.h, 1, 2 * t.i) JOIN {BYTES_VOCAB} r ON r.h = substr(t.h, 2 * t.i + 1))"""


def _ascii(spark, sf_dir):
    return _vocab(spark, sf_dir).where(F.col("word").rlike("^[a-z]+$"))


@query(f'SELECT merged, "left", "right" FROM {MERGES_SQL}')
def vocab_merge_self_join(spark, sf_dir):
    return vocabulary.merges(_vocab(spark, sf_dir))


@query(f"SELECT merged AS token_id, count(*) AS n_pairs FROM {MERGES_SQL} GROUP BY merged")
def expansion_counts(spark, sf_dir):
    return vocabulary.expansions(_vocab(spark, sf_dir)).select("token_id", F.size("pairs").cast("bigint").alias("n_pairs"))


@query(f'SELECT "left", "right", merged FROM {MERGES_SQL}')
def contraction_table(spark, sf_dir):
    return vocabulary.contractions(_vocab(spark, sf_dir))


LIST = "(SELECT a AS affix, CASE (i - 1) % 3 WHEN 0 THEN 'prefix' WHEN 1 THEN 'infix' ELSE 'suffix' END AS affix_type FROM (SELECT unnest([{}]) AS a, generate_subscripts([{}], 1) AS i))".format(*[",".join(f"'{a}'" for a in AFFIXES)] * 2)


@query(f"""SELECT DISTINCT unnest(CASE affix_type WHEN 'prefix' THEN [affix, ' ' || affix, upper(substr(affix, 1, 1)) || substr(affix, 2), ' ' || upper(substr(affix, 1, 1)) || substr(affix, 2)]
    WHEN 'suffix' THEN [affix, affix || ' '] ELSE [affix] END) AS version, affix, affix_type FROM {LIST}""")
def affix_versions(spark, sf_dir):
    return vocabulary.affix_versions(_affixes(spark))


@query(f"SELECT v.id AS token_id, l.affix AS version FROM {LIST} l JOIN {VOCAB_SQL} v ON v.word = l.affix")
def affix_ids(spark, sf_dir):
    return vocabulary.affix_ids(_affixes(spark).select(F.col("affix").alias("version")), _vocab(spark, sf_dir))


@query(f"""SELECT affix, count(*) AS n_docs, sum((length(t) - length(replace(t, affix, ''))) // length(affix))::BIGINT AS n_matches FROM (SELECT lower(text) AS t FROM documents) d JOIN {LIST} l ON contains(d.t, l.affix) GROUP BY affix""")
def affix_match_counts(spark, sf_dir):
    return expand.affix_matches(table(spark, sf_dir, "documents").select(F.lower("text").alias("t")), "t", _affixes(spark))


MEANINGFUL_SQL = ", ".join(f"'{m}'" for m in vocabulary.MEANINGFUL)
PIECE_SQL = f"""CASE WHEN length(x) = 1 THEN CASE WHEN regexp_matches(x, '[aeiou]') THEN 0.5 ELSE -1.0 END ELSE 0.0 END
  + CASE WHEN length(x) >= 2 AND regexp_matches(x, '^[^aeiou].*[aeiou]') THEN 0.5 ELSE 0.0 END + CASE WHEN x IN ({MEANINGFUL_SQL}) THEN 1.5 ELSE 0.0 END"""
#: Every split by a bit mask of its cuts; scores of few, balanced, syllable-like and meaningful pieces.
DECOMPOSITIONS_SQL = f"""(WITH v AS (SELECT list(word) AS known FROM {VOCAB_SQL}), a AS (SELECT DISTINCT affix, list_contains((SELECT known FROM v), affix) AS inside FROM {LIST}),
  masks AS (SELECT affix, unnest(range(1, (1 << (length(affix) - 1)::INT)::BIGINT)) AS mask FROM a WHERE NOT inside),
  ways AS (SELECT affix, list_filter(range(1, length(affix)), lambda i: (mask >> (i - 1)) & 1 = 1) AS cuts FROM masks),
  pieces AS (SELECT affix, cuts, list_transform(range(1, len(cuts) + 2), lambda j: substr(affix, coalesce(list_prepend(0, cuts)[j], 0) + 1, list_append(cuts, length(affix))[j] - list_prepend(0, cuts)[j])) AS tokens FROM ways WHERE len(cuts) <= 4),
  fits AS (SELECT affix, cuts, tokens, list_transform(tokens, lambda x: length(x)::DOUBLE) AS sizes FROM pieces WHERE list_has_all((SELECT known FROM v), tokens)),
  scored AS (SELECT affix, cuts, tokens, greatest(0.0, 5.0 + CASE len(tokens) WHEN 2 THEN 3.0 WHEN 3 THEN 1.5 ELSE 3.0 - len(tokens) END
      + CASE WHEN list_avg(list_transform(sizes, lambda x: (x - list_avg(sizes)) * (x - list_avg(sizes)))) < 1.0 THEN 1.0 ELSE 0.0 END + list_sum(list_transform(tokens, lambda x: {PIECE_SQL})))::DOUBLE AS score FROM fits),
  spelled AS (SELECT affix, string_split(affix, '') AS tokens FROM a WHERE NOT inside AND affix NOT IN (SELECT affix FROM scored) AND list_has_all((SELECT known FROM v), string_split(affix, '')))
  SELECT affix, tokens, score, kind AS decomposition_type, row_number() OVER (PARTITION BY affix ORDER BY score DESC, len(cuts), cuts) AS place FROM (
    SELECT affix, tokens, score, 'optimal' AS kind, cuts FROM scored UNION ALL SELECT affix, tokens, {vocabulary.FALLBACK_SCORE}, 'fallback', [] FROM spelled UNION ALL SELECT affix, [affix], {vocabulary.EXACT_SCORE}, 'exact_match', [] FROM a WHERE inside))"""


@query(f"SELECT affix, array_to_string(tokens, '|') AS tokens, round(score, 6) AS score, decomposition_type FROM {DECOMPOSITIONS_SQL} WHERE place = 1")
def affix_decomposition_best(spark, sf_dir):
    made = vocabulary.best_decompositions(_affixes(spark), _vocab(spark, sf_dir))
    return made.select("affix", F.array_join("tokens", "|").alias("tokens"), F.round("score", 6).alias("score"), "decomposition_type")


@query(f"SELECT affix, place::INT AS place, array_to_string(tokens, '|') AS tokens, round(score, 6) AS score FROM {DECOMPOSITIONS_SQL} WHERE place <= 3")
def affix_decompositions_top3(spark, sf_dir):
    made = vocabulary.decompositions(_affixes(spark), _vocab(spark, sf_dir)).where("place <= 3")
    return made.select("affix", "place", F.array_join("tokens", "|").alias("tokens"), F.round("score", 6).alias("score"))


@query(f"""WITH v AS (SELECT word FROM {VOCAB_SQL}), l AS (SELECT affix, affix IN (SELECT word FROM v) AS inside FROM {LIST})
    SELECT tokenizer, count(*) AS total_affixes, sum(hit)::BIGINT AS in_vocabulary, round(avg(hit), 6) AS coverage_rate FROM (
      SELECT 'words' AS tokenizer, inside::INT AS hit FROM l UNION ALL SELECT 'letters', (length(affix) = 1)::INT FROM l) GROUP BY tokenizer""")
def coverage_by_tokenizer(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    both = vocabulary.coverage(_affixes(spark), vocab, tokenizer="words").unionByName(vocabulary.coverage(_affixes(spark), vocab.where(F.length("word") == 1), tokenizer="letters"))
    return both.select("tokenizer", "total_affixes", "in_vocabulary", "coverage_rate")


@query(f"SELECT affix, place::INT AS place, other, ratio FROM {task_sql.similar(f'(SELECT DISTINCT affix FROM {LIST})')}")
def similar_affixes_topk(spark, sf_dir):
    return vocabulary.similar_affixes(_affixes(spark)).select("affix", "place", "other", "ratio")


#: A byte-level vocabulary: all bytes, then the prefixes of frequent words, alone and after a space, by length and text.
OFTEN = 20
BYTES_SQL = rf"""(WITH w AS (SELECT w FROM (SELECT unnest(regexp_extract_all(text, '\p{{L}}+')) AS w FROM documents) GROUP BY w HAVING count(*) >= {OFTEN}),
    p AS (SELECT DISTINCT substr(x, 1, n::INT) AS t FROM (SELECT x, unnest(range(1, length(x) + 1)) AS n FROM (SELECT w AS x FROM w UNION ALL SELECT ' ' || w FROM w)))
    SELECT i::INT AS id, printf('%02X', i) AS h FROM range(256) b(i)
    UNION ALL SELECT (255 + row_number() OVER (ORDER BY octet_length(encode(t)), t))::INT, hex(encode(t)) FROM p WHERE octet_length(encode(t)) > 1)"""
#: How the queries' texts are cut before tokens are merged.
CUT = r" ?\p{L}+| ?\p{N}+| ?[^ \t\n\r\p{L}\p{N}]+|[ \t\n\r]+"
PAIRS_SQL = """(SELECT t.id AS merged, l.id AS "left", r.id AS "right" FROM (SELECT id, h, unnest(range(1, length(h) // 2)) AS i FROM v) t
    JOIN v l ON l.h = substr(t.h, 1, 2 * t.i) JOIN v r ON r.h = substr(t.h, 2 * t.i + 1))"""
#: Pieces of the items, merged again and again at the leftmost pair of the least id.
ENCODED_SQL = f"""v AS MATERIALIZED {BYTES_SQL},
  items AS (SELECT item_id, regexp_extract_all(text, '{CUT}') AS ps FROM benchmark WHERE text IS NOT NULL),
  pieces AS (SELECT DISTINCT unnest(ps) AS piece FROM items),
  merged AS (SELECT piece, list_transform(range(1, length(h), 2), lambda i: substr(h, i, 2)) AS s FROM (SELECT piece, hex(encode(piece)) AS h FROM pieces)
    UNION ALL SELECT piece, s[:i - 1] || [s[i] || s[i + 1]] || s[i + 2:] FROM (SELECT piece, any_value(s) AS s, arg_min(i, id * 1000000::BIGINT + i) AS i
      FROM (SELECT piece, s, unnest(range(1, len(s))) AS i FROM merged) x JOIN v ON v.h = x.s[i] || x.s[i + 1] GROUP BY piece)),
  spelled AS (SELECT piece, list(id ORDER BY j) AS ids FROM (SELECT piece, s, unnest(range(1, len(s) + 1)) AS j FROM (SELECT piece, arg_min(s, len(s)) AS s FROM merged GROUP BY piece)) x JOIN v ON v.h = x.s[j] GROUP BY piece),
  encoded AS (SELECT item_id, flatten(list(ids ORDER BY j)) AS ids FROM (SELECT item_id, ps, unnest(range(1, len(ps) + 1)) AS j FROM items) x JOIN spelled ON piece = ps[j] GROUP BY item_id)"""


def _bytes_vocab(spark, sf_dir):
    from ..operators.ordering import with_row_index

    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
    often = found.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).select(F.explode(F.array("w", F.concat(F.lit(" "), "w"))).alias("x"))
    prefixes = often.select(F.explode(F.sequence(F.lit(1), F.length("x"))).alias("n"), "x").select(F.substr("x", F.lit(1), F.col("n")).alias("t")).distinct()
    sized = prefixes.withColumn("size", F.octet_length("t")).where("size > 1")
    numbered = with_row_index(sized, "size", "t").select(F.encode("t", "UTF-8").alias("token"), (F.col("row_index") + 256).cast("int").alias("token_id"))
    single = spark.range(256).select(F.unhex(F.format_string("%02X", "id")).alias("token"), F.col("id").cast("int").alias("token_id"))
    return single.unionByName(numbered)


def _entries(spark, sf_dir):
    """The vocabulary grows with the documents, so it is joined to the rows and not shared."""
    return expand.entries(_bytes_vocab(spark, sf_dir), vocabulary.affix_versions(_affixes(spark)))


def _known_items(spark, sf_dir, entries):
    """Whole texts as ids and what of the vocabulary they hold; a null text has none and is left out."""
    items = expand.with_known(table(spark, sf_dir, "benchmark").where("text IS NOT NULL"), F.col("text"), entries)
    return items.select("item_id", "text", "known", expand.known_encoder(CUT)(F.col("text"), F.col("known")).alias("ids"))


def _joined(ids):
    return F.array_join(F.col(ids).cast("array<string>"), " ")


@query(f"WITH RECURSIVE {ENCODED_SQL} SELECT item_id, array_to_string(ids, ' ') AS ids FROM encoded")
def merged_encoding(spark, sf_dir):
    return _known_items(spark, sf_dir, _entries(spark, sf_dir)).select("item_id", _joined("ids").alias("ids"))


def _edited(spark, sf_dir, edit, single=False, **options):
    """``single``: the ids are the texts' bytes, not merged."""
    made = _known_items(spark, sf_dir, _entries(spark, sf_dir))
    if single:
        made = made.withColumn("ids", F.transform(F.sequence(F.lit(1), F.octet_length("text")), lambda i: F.ascii(F.decode(F.substr(F.encode("text", "UTF-8"), i, F.lit(1)), "ISO-8859-1"))))
    made = made.select("item_id", "text", "known", "ids", expand.known_edit(edit, seed=1, pattern=CUT, **options)(F.col("item_id"), F.col("ids"), F.col("known")).alias("edited"))
    return made.withColumns({"n_before": F.size("ids"), "n_after": F.size("edited")})


def _draw_sql(name, step: str, what: str) -> str:
    return number_sql(f"concat_ws('|', '1', item_id, {name}{step}, '{what}')")


#: Tries at any place: the id there, or the pair that begins there, is replaced if the table of the edit has it.
TRIED_SQL = """WITH RECURSIVE {encoded}, pairs AS MATERIALIZED {pairs},
  splits AS (SELECT merged, list({{'l': "left", 'r': "right"}} ORDER BY "left", "right") AS ways FROM pairs GROUP BY merged),
  steps AS (SELECT item_id, 0 AS step, floor(len(ids) * 0.3::DOUBLE)::INT AS tries, ids AS s FROM encoded
    UNION ALL SELECT item_id, step + 1, tries, {replaced} FROM (SELECT *, {at} % {places} + 1 AS i FROM steps WHERE step < tries AND {places} > 0) x {join})
  SELECT e.item_id, len(e.ids)::INT AS n_before, len(s)::INT AS n_after, array_to_string(s, ' ') AS ids FROM (SELECT item_id, arg_max(s, step) AS s FROM steps GROUP BY item_id) JOIN encoded e USING (item_id)"""
EXPANDED_SQL = TRIED_SQL.format(
    encoded=ENCODED_SQL, pairs=PAIRS_SQL, at=_draw_sql("", "step", "at"), places="len(s)", join="LEFT JOIN splits t ON t.merged = x.s[x.i]",
    replaced=f"CASE WHEN ways IS NULL THEN s ELSE s[:i - 1] || [ways[{_draw_sql('', 'step', 'pair')} % len(ways) + 1].l, ways[{_draw_sql('', 'step', 'pair')} % len(ways) + 1].r] || s[i + 1:] END",
)
#: Contraction starts from single bytes, as merged texts have hardly a pair left.
CONTRACTED_SQL = TRIED_SQL.format(
    encoded=f"v AS MATERIALIZED {BYTES_SQL}, encoded AS (SELECT item_id, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::INT) AS ids FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark WHERE text IS NOT NULL))", pairs=PAIRS_SQL, at=_draw_sql("", "step", "at"), places="(len(s) - 1)", join='LEFT JOIN pairs c ON c."left" = x.s[x.i] AND c."right" = x.s[x.i + 1]',
    replaced="CASE WHEN c.merged IS NULL THEN s ELSE s[:i - 1] || [c.merged] || s[i + 2:] END",
)


@query(EXPANDED_SQL)
def stochastic_expand(spark, sf_dir):
    return _edited(spark, sf_dir, expand.expand, share=0.3).select("item_id", "n_before", "n_after", _joined("edited").alias("ids"))


@query(CONTRACTED_SQL)
def stochastic_contract(spark, sf_dir):
    return _edited(spark, sf_dir, expand.contract, single=True, share=0.3).select("item_id", "n_before", "n_after", _joined("edited").alias("ids"))


#: Six phases, expansions and contractions in turn; each step chooses among the places that the table has, affixes last or first.
CYCLES_SQL = f"""WITH RECURSIVE {ENCODED_SQL}, pairs AS MATERIALIZED {PAIRS_SQL},
  affix AS MATERIALIZED (SELECT v.id FROM v JOIN (SELECT DISTINCT hex(encode(unnest(CASE affix_type WHEN 'prefix' THEN [affix, ' ' || affix, upper(substr(affix, 1, 1)) || substr(affix, 2), ' ' || upper(substr(affix, 1, 1)) || substr(affix, 2)]
    WHEN 'suffix' THEN [affix, affix || ' '] ELSE [affix] END))) AS h FROM {LIST}) USING (h)),
  splits AS MATERIALIZED (SELECT merged, list({{'l': "left", 'r': "right"}} ORDER BY "left", "right") AS ways, merged IN (SELECT id FROM affix) AS is_affix FROM pairs GROUP BY merged),
  joins AS MATERIALIZED (SELECT "left", "right", merged, merged IN (SELECT id FROM affix) AS is_affix FROM pairs),
  steps AS (SELECT item_id, 0 AS phase, 0 AS step, floor(len(ids) * 0.3::DOUBLE)::INT AS tries, ids AS s, 0 AS n FROM encoded
    UNION ALL SELECT item_id, CASE WHEN ended THEN phase + 1 ELSE phase END, CASE WHEN ended THEN 0 ELSE step + 1 END, CASE WHEN ended THEN floor(len(s) * 0.3::DOUBLE)::INT ELSE tries END,
      CASE WHEN ended THEN s WHEN phase % 2 = 0 THEN s[:i - 1] || [ways[{_draw_sql("phase, ", "step", "pair")} % len(ways) + 1].l, ways[{_draw_sql("phase, ", "step", "pair")} % len(ways) + 1].r] || s[i + 1:] ELSE s[:i - 1] || [merged] || s[i + 2:] END, n + 1
    FROM (SELECT *, CASE WHEN phase % 2 = 0 THEN places_ways[list_position(places, i)] END AS ways, CASE WHEN phase % 2 = 1 THEN places_merged[list_position(places, i)] END AS merged FROM (
      SELECT *, step >= tries OR len(places) = 0 AS ended, CASE WHEN len(liked) > 0 AND (phase % 2 = 0 OR {_draw_sql("phase, ", "step", "prefer")} < 0.7::DOUBLE * 4294967296) THEN liked[{_draw_sql("phase, ", "step", "at")} % len(liked) + 1] ELSE places[{_draw_sql("phase, ", "step", "at")} % greatest(len(places), 1) + 1] END AS i FROM (
        SELECT item_id, any_value(phase) AS phase, any_value(step) AS step, any_value(tries) AS tries, any_value(s) AS s, any_value(n) AS n,
          coalesce(list(j ORDER BY j) FILTER (able), []) AS places, coalesce(list(j ORDER BY j) FILTER (able AND is_liked), []) AS liked, list(ways ORDER BY j) FILTER (able) AS places_ways, list(merged ORDER BY j) FILTER (able) AS places_merged
        FROM (SELECT x.item_id, phase, step, tries, s, n, j, t.ways, c.merged, CASE WHEN phase % 2 = 0 THEN t.merged IS NOT NULL ELSE c.merged IS NOT NULL END AS able, CASE WHEN phase % 2 = 0 THEN NOT t.is_affix ELSE c.is_affix END AS is_liked
          FROM (SELECT *, unnest(range(1, len(s) + 1)) AS j FROM steps WHERE phase < 6) x LEFT JOIN splits t ON t.merged = x.s[x.j] LEFT JOIN joins c ON c."left" = x.s[x.j] AND c."right" = x.s[x.j + 1])
        GROUP BY item_id))))
  SELECT e.item_id, len(e.ids)::INT AS n_before, len(s)::INT AS n_after, array_to_string(s, ' ') AS ids FROM (SELECT item_id, arg_max(s, n) AS s FROM steps GROUP BY item_id) JOIN encoded e USING (item_id)"""


@query(CYCLES_SQL)
def affix_cycles(spark, sf_dir):
    return _edited(spark, sf_dir, expand.cycles).select("item_id", "n_before", "n_after", _joined("edited").alias("ids"))


@query(f"WITH RECURSIVE {ENCODED_SQL} SELECT item_id, len(ids)::INT AS n_before, text, len(ids) > 1 AS changed FROM encoded JOIN benchmark USING (item_id)")
def affix_contract_expand(spark, sf_dir):
    """SQL has no merging within a recursion; tests hold the edit itself against plain lists."""
    made = _edited(spark, sf_dir, expand.contract_expand, contract_share=0.5)
    return made.select("item_id", "n_before", expand.known_decoder()(F.col("edited"), F.col("known")).alias("text"), (F.col("ids") != F.col("edited")).alias("changed"))
