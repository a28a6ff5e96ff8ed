"""Benchmark tasks from lexicons and annotations, one projection a kind of task.

Task rows are (category, subcategory, text_en, text_tl, answer, wrong, key): ``wrong`` holds the
distractors of a multiple-choice task and is null for a generative one, and ``key`` orders rows.
Choices that the tasks make at random are functions of the seed and the word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars, syllables
from ..functions.seeded import number, order_key, pick, shuffled
from ..operators.ordering import balanced_answers, groups_of_four
from ..operators.sampling import least_of_each
from ..working import materialize
from . import prompts

STRINGS = "array<string>"
MIN_LENGTH = {"composition": 3, "manipulation": 5, "syllabification": 3, "long_words": 7}


def task(df: DataFrame, category: str, subcategory: str | Column, texts: tuple[Column, Column], answer: Column, wrong: Column | None, key: Column) -> DataFrame:
    return df.select(
        F.lit(category).alias("category"),
        (F.lit(subcategory) if isinstance(subcategory, str) else subcategory).alias("subcategory"),
        texts[0].alias("text_en"),
        texts[1].alias("text_tl"),
        answer.cast("string").alias("answer"),
        (F.lit(None).cast(STRINGS) if wrong is None else wrong.cast(STRINGS)).alias("wrong"),
        key.cast("string").alias("key"),
    )


def rendered(pair: tuple[str, str], **values: Column) -> tuple[Column, Column]:
    return prompts.render(pair[0], **values), prompts.render(pair[1], **values)


def by_value(pairs: dict[str, tuple[str, str]], value: Column, **values: Column) -> tuple[Column, Column]:
    """The texts of the pair that ``value`` names."""
    out = []
    for i in (0, 1):
        text = F.lit(None).cast("string")
        for name, pair in pairs.items():
            text = F.when(value == name, prompts.render(pair[i], **values)).otherwise(text)
        out.append(text)
    return out[0], out[1]


def _except(options: Column, right: Column) -> Column:
    return F.filter(options, lambda x: x != right)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def first(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def sampled(df: DataFrame, n: int | None, seed: int, key: str = "normalized_word") -> DataFrame:
    """``n`` rows in the seeded order; with a ``rank`` column and a weight use the sampling operator before.

    Entries that are one without marks are told apart by the word, so the order is total.
    """
    return df if n is None else df.orderBy(order_key(seed, F.col(key)), key, *(["word"] if "word" in df.columns and key != "word" else [])).limit(n)


# --- nested and flat forms -------------------------------------------------------------------


def mcq_items(tasks: DataFrame, seed: int = 42) -> DataFrame:
    """Nested multiple-choice items: options, choices 1 to 4 with balanced right places, and a label."""
    placed = balanced_answers(tasks.where(F.size("wrong") == 3), F.col("answer"), F.col("wrong"), seed, "subcategory", "key", "text_en")
    options = F.struct(F.col("answer").alias("correct"), *[F.get("wrong", F.lit(i)).alias(f"incorrect{i + 1}") for i in range(3)])
    prompt = F.struct("text_en", "text_tl", options.alias("mcq_options"), "choice1", "choice2", "choice3", "choice4")
    return placed.select("category", "subcategory", F.array(prompt).alias("prompts"), "label", "row_index", "key")


def gen_items(tasks: DataFrame) -> DataFrame:
    return tasks.select("category", "subcategory", F.array(F.struct("text_en", "text_tl")).alias("prompts"), F.col("answer").alias("label"))


def flat_mcq(tasks: DataFrame, seed: int = 42) -> DataFrame:
    """question, answer and four options in a seeded order; other numbers of options are left out."""
    options = F.concat(F.array("answer"), F.col("wrong"))
    return tasks.where(F.size("wrong") == 3).select("category", "subcategory", F.col("text_tl").alias("question"), "answer", shuffled(options, seed, F.col("key")).alias("options"))


def flat_gen(tasks: DataFrame) -> DataFrame:
    return tasks.select("category", "subcategory", F.col("text_tl").alias("question"), "answer")


def to_generative(items: DataFrame) -> DataFrame:
    """Multiple-choice rows (question, answer, options) without their options."""
    return items.drop("options")


# --- affixation ------------------------------------------------------------------------------


def affixation(inflections: DataFrame, form: str = "mcq") -> DataFrame:
    """Inflection of roots, and identification of the affix (no circumfixes) with the three nearest affixes."""
    inflections = materialize(inflections, "inflections")
    names = {c: F.coalesce(c, F.lit("")) for c in ("prefix", "suffix", "infix", "root")}
    kind = F.col("affix_type")
    texts = by_value(prompts.AFFIX_MCQ if form == "mcq" else prompts.AFFIX_GEN, kind, **names)
    wrong = F.array("incorrect1", "incorrect2", "incorrect3") if form == "mcq" else None
    inflection = task(inflections, "affixation", F.concat(F.lit("inflection_"), kind), texts, F.col("correct"), wrong, F.col("correct"))
    affix = F.when(kind == "prefix", F.col("prefix")).when(kind == "suffix", F.col("suffix")).when(kind == "infix", F.col("infix"))
    simple = inflections.where(kind != "circumfix").withColumn("affix", affix).where("affix IS NOT NULL")
    if form == "gen":
        named = task(simple, "affixation", F.concat(F.lit("identification_"), kind), rendered(prompts.AFFIX_ID_GEN), F.col("affix"), None, F.col("correct"))
        return inflection.unionByName(named)
    from ..operators.vocabulary import similar_affixes

    all_ = union([inflections.select(F.col(c).alias("affix")) for c in ("prefix", "suffix", "infix")]).where("affix IS NOT NULL").distinct()
    near = similar_affixes(all_, 3).groupBy("affix").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda s: s["other"]).alias("near"))
    joined = simple.join(F.broadcast(near), "affix")  # as long as the list of affixes
    named = task(joined, "affixation", F.concat(F.lit("identification_"), kind), rendered(prompts.AFFIX_ID_MCQ), F.col("affix"), F.col("near"), F.col("correct"))
    return inflection.unionByName(named)


# --- composition -----------------------------------------------------------------------------

COMPOSITION_GROUPS = ["character_exactly", "character_most", "character_least", "diacritic_exactly", "uppercase_exactly", "length_exactly", "length_most", "length_least"]


def _over(members: Column, f) -> Column:
    return F.transform(members, lambda m: f(m["normalized_word"]))


def _wrong(words: Column, right: Column) -> Column:
    return F.slice(F.filter(F.array_distinct(words), lambda w: w != right), 1, 3)


def _where_count(words: Column, counts: Column, wanted: Column) -> Column:
    """The first word with the wanted count."""
    return F.get(F.filter(F.arrays_zip(words.alias("w"), counts.alias("c")), lambda x: x["c"] == wanted), F.lit(0))["w"]


def composition(lexicon: DataFrame, n: int | None = None, form: str = "mcq", seed: int = 100) -> DataFrame:
    """``lexicon`` (word, normalized_word): spelling, and counts of characters, marks, capitals and length."""
    words = materialize(lexicon.where(F.length("normalized_word") >= MIN_LENGTH["composition"]).select("word", "normalized_word"), "composed-words")
    w, key = F.col("normalized_word"), F.col("normalized_word")
    if form == "gen":
        letter = chars.random_char(w, seed)
        parts = [
            task(sampled(words, n, seed), "composition", "spelling", rendered(prompts.SPELLING_GEN), chars.spell(w), None, key),
            task(sampled(words, n, seed + 1), "composition", "character", rendered(prompts.CHARACTER_GEN, character=letter), chars.count_char(w, letter), None, key),
            task(sampled(words, n, seed + 2), "composition", "length", rendered(prompts.LENGTH_GEN), F.length(w), None, key),
            task(sampled(words.where(chars.has_diacritic(F.col("word"))), n, seed + 3), "composition", "diacritic", rendered(prompts.DIACRITIC_GEN), chars.count_diacritics(F.col("word")), None, key),
            task(sampled(words.where(w.rlike(r"\p{Lu}")), n, seed + 4), "composition", "uppercase", rendered(prompts.UPPERCASE_GEN), chars.count_upper(w), None, key),
        ]
        return union(parts)
    spelling = task(sampled(words, n, seed), "composition", "spelling", rendered(prompts.SPELLING_MCQ), chars.spell(w), chars.perturbations(w, seed), key)
    counted = {subject: enough_groups(words, subject, n, seed) for subject in ("character", "diacritic", "uppercase", "length")}
    return union([spelling, *[first(_group_task(counted[kind.partition("_")[0]], kind), n, F.col("key")) for kind in COMPOSITION_GROUPS]])


#: Rounds of grouping at most; group ids of a round begin at its number times ROUND_IDS.
ROUNDS, ROUND_IDS = 5, 100_000_000_000


def enough_groups(words: DataFrame, subject: str, n: int | None, seed: int = 100, rounds: int = ROUNDS) -> DataFrame:
    """Unambiguous groups of four for a subject, as ``counted_groups`` gives them: at least ``n`` if the rounds find them.

    Words of groups that were ambiguous are ordered anew and grouped again, without those used
    already, until there are ``n`` groups, four words are not left, or ``rounds`` are over. Without
    ``n`` there is one round.
    """
    left, found, total = words.select("word", "normalized_word").distinct(), None, 0
    for i in range(rounds):
        order = order_key(seed if i == 0 else f"{seed}-{i}", F.col("normalized_word"))
        groups = groups_of_four(left.withColumn("_order", order), "_order", "normalized_word", "word")
        groups = materialize(groups.withColumn("group_id", F.col("group_id") + i * ROUND_IDS), "groups-of-four")
        good = materialize(counted_groups(groups, subject, seed), "counted-groups")
        found = good if found is None else found.unionByName(good)
        total += 0 if n is None else good.count()
        if n is None or total >= n or groups.isEmpty() or i + 1 == rounds:
            return found
        used = groups.join(good.select("group_id"), "group_id", "left_semi").select(F.explode(F.transform("members", lambda x: x["word"])).alias("word"))
        left = materialize(left.join(used, "word", "left_anti"), "words-left")
    return found


def counted_groups(groups: DataFrame, subject: str, seed: int = 100) -> DataFrame:
    """(group_id, words, char, counts) of the groups of four in which what is counted gives an unambiguous answer."""
    m = F.col("members")
    words = F.transform(m, lambda x: x["normalized_word"])
    marked = F.transform(m, lambda x: x["word"])
    base = groups.where(F.size(F.array_distinct(words)) == 4)
    if subject == "length":
        base = base.withColumn("counts", F.transform(words, lambda w: F.length(w))).withColumn("words", words).withColumn("char", F.lit(""))
    elif subject == "character":
        letters = F.array_distinct(F.flatten(F.transform(words, lambda w: chars.to_chars(w))))
        apart = F.filter(letters, lambda c: F.size(F.array_distinct(F.transform(words, lambda w: chars.count_char(w, c)))) == 4)
        base = base.select("group_id", words.alias("words"), pick(F.array_sort(apart), number(seed, F.array_join(words, "|"))).alias("char"))
        base = materialize(base, "chosen-letters")  # else the choice is made again for every use of the letter
        base = base.where("char IS NOT NULL").withColumn("counts", F.transform("words", lambda w: chars.count_char(w, F.col("char"))))
    else:
        count = chars.count_diacritics if subject == "diacritic" else chars.count_upper
        source = marked if subject == "diacritic" else words
        base = base.withColumn("words", source).withColumn("counts", F.transform("words", count)).withColumn("char", F.lit("diacritic" if subject == "diacritic" else "uppercase"))
        base = base.where(F.aggregate("counts", F.lit(0), lambda a, x: a + x) == 1)
    if subject in ("length", "character"):
        base = base.where(F.size(F.array_distinct("counts")) == 4)
    return base.select("group_id", "words", "char", "counts")


def group_task(groups: DataFrame, kind: str, seed: int = 100) -> DataFrame:
    """One task for each group of four words for which the answer is unambiguous."""
    return _group_task(counted_groups(groups, kind.partition("_")[0], seed), kind)


def _group_task(base: DataFrame, kind: str) -> DataFrame:
    subject, _, how = kind.partition("_")
    c, ws = F.col("counts"), F.col("words")
    wanted = F.array_max(c) if how == "most" else F.array_min(c) if how == "least" else F.lit(1) if subject in ("diacritic", "uppercase") else F.get(c, F.lit(0))
    texts = {
        "length_exactly": prompts.LENGTH_EXACTLY, "length_most": prompts.LENGTH_MOST, "length_least": prompts.LENGTH_LEAST,
        "character_most": prompts.CHAR_MOST, "character_least": prompts.CHAR_LEAST,
    }.get(kind, prompts.CHAR_EXACTLY)
    right = _where_count(ws, c, wanted)
    return task(base, "composition", kind, rendered(texts, target_count=wanted, target_length=wanted, char=F.col("char")), right, _wrong(ws, right), F.lpad(F.col("group_id").cast("string"), 12, "0"))


# --- manipulation ----------------------------------------------------------------------------


def manipulation(lexicon: DataFrame, n: int | None = None, form: str = "mcq", seed: int = 100) -> DataFrame:
    """Edits of every occurrence of a character, case changes and mark removal."""
    words = lexicon.where(F.length("normalized_word") >= MIN_LENGTH["manipulation"]).select("word", "normalized_word")
    w = F.col("normalized_word")
    # Chosen characters are written with the words, so each kind of task reads them instead of choosing again.
    own = F.array_sort(F.array_distinct(chars.to_chars(w)))
    alphabet = F.array(*[F.lit(c) for c in chars.ALPHABET])
    words = words.withColumn("_a", pick(own, number(f"{seed}-a", w)))
    a, new, b, other = F.col("_a"), F.col("_new"), F.col("_b"), F.col("_other")
    words = words.withColumn("_new", pick(F.array_except(alphabet, F.array(a)), number(f"{seed}-new", w)))
    words = words.withColumn("_b", F.coalesce(pick(F.array_except(own, F.array(a)), number(f"{seed}-b", w)), new))
    words = materialize(words.withColumn("_other", F.coalesce(pick(F.array_except(own, F.array(a, b)), number(f"{seed}-other", w)), new)), "edited-words")
    done = {
        "deletion": chars.delete_char(w, a),
        "insertion": chars.insert_char(w, a, new),
        "substitution": chars.substitute_char(w, a, new),
        "permutation": chars.permute_char(w, a, b),
        "duplication": chars.duplicate_char(w, a),
    }
    astray = {
        "deletion": chars.delete_char(w, other),
        "insertion": chars.insert_char(w, other, new),
        "substitution": chars.substitute_char(w, other, new),
        "permutation": chars.permute_char(w, a, F.when(other != b, other).otherwise(new)),
        "duplication": chars.duplicate_char(w, other),
    }
    names = {"char_to_delete": a, "char_to_insert": new, "preceding_char": a, "char_to_replace": a, "char_to_substitute": new, "char1": a, "char2": b, "char_to_duplicate": a}
    texts = prompts.MANIPULATION_MCQ if form == "mcq" else prompts.MANIPULATION_GEN
    parts = []
    for i, (kind, right) in enumerate(done.items()):
        rows = sampled(words, n, seed + i)
        # Two of the other operations, the identity included, and the operation with a wrong character.
        others = F.array(w, *[x for k, x in done.items() if k != kind])
        wrong = F.slice(F.array_distinct(F.concat(F.array(F.when(astray[kind] != right, astray[kind]).otherwise(F.concat(right, new))), _except(shuffled(others, f"{seed}-{kind}", w), right))), 1, 3)
        parts.append(task(rows, "manipulation", kind, rendered(texts[kind], **names), right, wrong if form == "mcq" else None, w))
    mixed, half = chars.random_case(w, seed), chars.half_upper(w)
    cased = words.where(w.rlike(r"\p{L}"))
    parts.append(task(sampled(cased, n, seed + 5), "manipulation", "uppercasing", rendered(texts["uppercasing"]), F.upper(w), F.array(F.lower(w), half, mixed) if form == "mcq" else None, w))
    parts.append(task(sampled(cased, n, seed + 6), "manipulation", "lowercasing", rendered(texts["lowercasing"]), F.lower(w), F.array(half, mixed, F.upper(w)) if form == "mcq" else None, w))
    v = F.col("word")
    bare = chars.normalize_diacritics(v)
    marks = F.array(v, chars.diacritize(v, seed), chars.diacritize(v, seed + 1, 0.5))
    marks = F.transform(marks, lambda x, i: F.when(x == bare, chars.from_chars(chars.shuffle_chars(chars.to_chars(v), f"{seed}-m"))).otherwise(x))
    parts.append(task(sampled(words.where(chars.has_diacritic(v)), n, seed + 7), "manipulation", "diacritic_normalization", rendered(texts["diacritic_normalization"]), bare, marks if form == "mcq" else None, w))
    return union(parts)


# --- syllabification -------------------------------------------------------------------------


def syllabification(lexicon: DataFrame, n: int | None = None, form: str = "mcq", seed: int = 100) -> DataFrame:
    """``lexicon`` with ``normalized_syllable_list``: stress, reduplication, and syllable counts."""
    words = lexicon.where(F.length("normalized_word") >= MIN_LENGTH["syllabification"])
    words = materialize(words.select("word", "normalized_word", "normalized_syllable_list", "last_syllable_pronunciation"), "syllable-words")
    w, parts_of = F.col("normalized_word"), F.col("normalized_syllable_list")
    kind = F.col("last_syllable_pronunciation")
    labels = F.array(*[F.lit(x) for x in syllables.STRESS_LABELS.values()])
    right = syllables.label_of(kind)
    stress = task(sampled(words.where(kind.isNotNull()), n, seed), "syllabification", "stress", rendered(prompts.STRESS), right, F.filter(labels, lambda x: x != right) if form == "mcq" else None, w)
    if form == "mcq":
        ordered = words.select("normalized_word", syllables.is_reduplicated(parts_of).alias("doubled")).distinct().withColumn("_order", order_key(seed, w))
        doubled = ordered.where("doubled").withColumn("_side", F.lit(0))
        plain = ordered.where("NOT doubled")
        triples = groups_of_four(plain, "_order", "normalized_word").select("group_id", F.transform(F.slice("members", 1, 3), lambda m: m["normalized_word"]).alias("plain"))
        from ..operators.ordering import with_row_index

        one = with_row_index(doubled.drop("_side"), "_order", "normalized_word").select(F.col("row_index").alias("group_id"), "normalized_word")
        redup = task(first(one.join(triples, "group_id"), n, F.col("group_id")), "syllabification", "reduplication", rendered(prompts.REDUPLICATION_MCQ), w, F.col("plain"), w)
    else:
        redup = task(sampled(words.where(syllables.is_reduplicated(parts_of)), n, seed + 1), "syllabification", "reduplication", rendered(prompts.REDUPLICATION_GEN), syllables.reduplicated_syllable(parts_of), None, w)
    count = F.size(parts_of)
    near = F.slice(F.filter(F.array(count - 1, count + 1, count + 2), lambda x: x > 0), 1, 3)
    wrong = F.concat(near, F.array_repeat(count, F.lit(3) - F.size(near))) if form == "mcq" else None
    with_ng = words.where(chars.contains_ng(w)).withColumn("_ng", F.lit(0)).unionByName(words.where(~chars.contains_ng(w)).withColumn("_ng", F.lit(1)))
    ng = with_ng if n is None else with_ng.orderBy("_ng", order_key(seed + 2, w), w, "word").limit(n)
    counted = [
        task(ng, "syllabification", "syllable_counting_ng", rendered(prompts.SYLLABLES), count, wrong, w),
        task(sampled(words.where(F.length(w) >= MIN_LENGTH["long_words"]), n, seed + 3), "syllabification", "syllable_counting", rendered(prompts.SYLLABLES), count, wrong, w),
    ]
    return union([stress, redup, *counted])


# --- stress on homographs --------------------------------------------------------------------


def homographs(lexicon: DataFrame) -> DataFrame:
    """(folded, entries, n): words that are written alike without marks and differ in stress."""
    folded = F.lower("normalized_word")
    grouped = lexicon.groupBy(folded.alias("folded")).agg(
        F.array_sort(F.collect_list(F.struct("word", "normalized_word", "part_of_speech", "accented_syllable_index", "normalized_syllable_list", "last_syllable_pronunciation"))).alias("entries"),
        F.count_distinct("last_syllable_pronunciation").alias("n_stress"),
    )
    return grouped.where("n_stress > 1")


def stress(lexicon: DataFrame, n: int | None = None, form: str = "mcq", seed: int = 42) -> DataFrame:
    """Which syllable is stressed, which kind of stress, and where the marks go."""
    chosen = homographs(lexicon).withColumn("e", pick(F.col("entries"), number(seed, F.col("folded"))))
    chosen = materialize(chosen if n is None else chosen.orderBy(order_key(seed, F.col("folded")), "folded").limit(n), "homographs")
    word, accented = F.col("e.normalized_word"), F.col("e.word")
    context = syllables.context_of(word, F.coalesce("e.part_of_speech", F.lit("pnb")), seed)
    key = F.col("folded")
    total = F.greatest(F.size("e.normalized_syllable_list"), F.lit(1))
    at = F.when(F.col("e.accented_syllable_index") >= 0, F.col("e.accented_syllable_index").cast("int") + 1).otherwise(total)
    places = F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: i != at)
    identification = task(chosen, "stress_identification", "syllable_position", rendered(prompts.STRESSED_SYLLABLE, word=word, context=context), chars.ordinal(at), F.slice(F.transform(places, lambda i: chars.ordinal(i)), 1, 3) if form == "mcq" else None, key)
    labels = F.array(*[F.lit(x) for x in syllables.STRESS_BENCHMARK_LABELS.values()])
    right = syllables.label_of(F.coalesce("e.last_syllable_pronunciation", F.lit("malumay")), syllables.STRESS_BENCHMARK_LABELS)
    classification = task(chosen, "stress_classification", "stress_type", rendered(prompts.STRESS_KIND, word=word, context=context), right, F.filter(labels, lambda x: x != right) if form == "mcq" else None, key)
    others = F.filter(F.transform("entries", lambda x: x["word"]), lambda x: x != accented)
    others = F.slice(F.concat(others, F.array_repeat(word, 3)), 1, 3)
    marks = task(chosen, "deaccent", "accent_placement", rendered(prompts.ACCENT_MARKS, word=word, context=context), accented, others if form == "mcq" else None, key)
    return union([identification, classification, marks])


# --- hierarchical levels ---------------------------------------------------------------------


def _level(df: DataFrame, level: int, category: str, kind: str, answer: Column, wrong: Column | None, values: dict[str, Column], subcategory: Column | None = None) -> DataFrame:
    word = values.get("word", F.col("word"))
    base = task(df, category, F.lit(kind) if subcategory is None else subcategory, rendered(prompts.LEVELS[kind], **{"word": word, **values}), answer, wrong, word)
    return base.withColumn("level", F.lit(level))


def _three(options: Column, right: Column, seed: object, key: Column) -> Column:
    """Up to three of the options that are not right, in a seeded order."""
    return F.slice(shuffled(F.array_distinct(F.filter(options, lambda x: x.isNotNull() & (x != right))), str(seed), key), 1, 3)


def word_levels(words: DataFrame, n: int | None = None, form: str = "mcq", seed: int = 42) -> DataFrame:
    """Levels 0 and 1 on ``words`` (word): characters by place, counts, presence, and edits by place."""
    rows = words.where(F.length("word") >= 3).select("word").distinct()
    rows = materialize(rows if n is None else rows.orderBy(order_key(seed, F.col("word")), "word").limit(n), "level-words")
    w, size = F.col("word"), F.length("word")
    mcq = form == "mcq"
    p = (F.pmod(number(f"{seed}-p", w), size) + 1).cast("int")
    letters = F.array_sort(F.array_distinct(chars.to_chars(w)))
    alphabet = F.array(*[F.lit(c) for c in chars.ALPHABET])
    c = pick(letters, number(f"{seed}-c", w))
    new = pick(F.array_except(alphabet, F.array(chars.char_at(w, p))), number(f"{seed}-new", w))
    q = (F.pmod(p + F.pmod(number(f"{seed}-q", w), size - 1), size) + 1).cast("int")
    places = F.sequence(F.lit(1), size)
    at = {"position": p, "ordinal": chars.ordinal(p)}
    count = chars.count_char(w, c)
    near = F.filter(F.array(count - 1, count + 1, count - 2, count + 2), lambda x: x >= 0)
    absent = pick(F.array_except(alphabet, chars.to_chars(F.lower(w))), number(f"{seed}-absent", w))
    has = F.pmod(number(f"{seed}-has", w), F.lit(2)) == 0
    asked = F.when(has, c).otherwise(F.coalesce(absent, c))
    deleted, inserted, replaced, swapped = chars.delete_at(w, p), chars.insert_at(w, p, new), chars.substitute_at(w, p, new), chars.swap_at(w, p, q)
    wrong = lambda f, right, tag: _three(F.transform(places, f), right, f"{seed}-{tag}", w) if mcq else None
    parts = [
        _level(rows, 0, "recognition", "character_identification", chars.char_at(w, p), _three(F.concat(letters, F.slice(shuffled(F.array_except(alphabet, letters), seed, w), 1, 3)), chars.char_at(w, p), seed, w) if mcq else None, at),
        _level(rows, 0, "recognition", "character_counting", count, F.slice(near, 1, 3) if mcq else None, {"char": c}),
        _level(rows, 0, "recognition", "character_presence", F.when(F.contains(w, asked), "Yes").otherwise("No"), None, {"char": asked}),
        _level(rows, 1, "manipulation", "deletion", deleted, wrong(lambda i: chars.delete_at(w, i), deleted, "del"), at),
        _level(rows, 1, "manipulation", "insertion", inserted, wrong(lambda i: chars.insert_at(w, i, new), inserted, "ins"), {"position": p, "char": new}),
        _level(rows, 1, "manipulation", "substitution", replaced, wrong(lambda i: chars.substitute_at(w, i, new), replaced, "sub"), {**at, "char": new}),
        _level(rows, 1, "manipulation", "permutation", swapped, wrong(lambda i: chars.swap_at(w, i, F.pmod(i, size).cast("int") + 1), swapped, "swap"), {"pos1": p, "pos2": q}),
    ]
    return union(parts)


def affix_rows(annotated: DataFrame, seed: int = 42) -> DataFrame:
    """``annotated`` (word, root, prefix, infix, suffix) with one of its affixes chosen: affix_type, affix."""
    given = F.filter(F.array(*[F.struct(F.lit(k).alias("affix_type"), F.col(k).alias("affix")) for k in ("prefix", "infix", "suffix")]), lambda x: x["affix"].isNotNull())
    chosen = annotated.where(F.col("root").isNotNull()).withColumn("_a", pick(given, number(seed, F.col("word")))).where("_a IS NOT NULL")
    return chosen.select("word", "root", "prefix", "infix", "suffix", "_a.affix_type", "_a.affix")


#: Roots of a bucket on average, of which one may be drawn; draws for each word.
BUCKET, ROOT_DRAWS = 4, 8
#: Affixes of all types up to which they go to every row as pools.
MOST_AFFIXES = 100_000


def other_roots(rows: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """(word, others): a few roots for each wanted word, drawn without numbering them.

    Roots are dealt to buckets by their hash, and each bucket's least is what its number draws.
    """
    roots = materialize(rows.select("root").distinct(), "roots")
    buckets = max(1, roots.count() // BUCKET)
    drawn = roots.groupBy(F.pmod(number(f"{seed}-bucket", F.col("root")), F.lit(buckets)).alias("bucket")).agg(F.min_by("root", F.struct(order_key(seed, F.col("root")), "root")).alias("other"))
    asked = wanted.select("word", F.explode(F.sequence(F.lit(0), F.lit(ROOT_DRAWS - 1))).alias("i")).select("word", F.pmod(number(seed, F.col("word"), F.col("i")), F.lit(buckets)).alias("bucket"))
    return asked.join(drawn, "bucket").groupBy("word").agg(F.array_sort(F.collect_set("other")).alias("others"))


def affix_levels(annotated: DataFrame, n: int | None = None, form: str = "mcq", seed: int = 42) -> DataFrame:
    """Levels 2 to 5: name the affix, find the root, count syllables, remove, apply, and both in a row.

    The words are chosen first; what else a task needs is sampled for them alone.
    """
    rows = materialize(affix_rows(annotated, seed), "affix-rows")
    mcq = form == "mcq"
    affixes = materialize(rows.select("affix_type", "affix").distinct(), "affixes")
    if affixes.count() > MOST_AFFIXES:
        raise ValueError(f"more than {MOST_AFFIXES} affixes can't go to every row")
    pools = affixes.groupBy("affix_type").agg(F.array_sort(F.collect_list("affix")).alias("pool"))  # three rows
    out = rows if n is None else rows.orderBy(order_key(seed, F.col("word")), "word").limit(n)
    out = materialize(out.join(F.broadcast(pools), "affix_type").withColumn("count", F.size(syllables.syllabify(F.col("word")))), "chosen-words")
    others = other_roots(rows, out, seed)
    out = materialize(out.join(others, "word", "left").withColumn("others", F.coalesce("others", F.array().cast(STRINGS))), "level-rows")
    w, root, affix, kind = F.col("word"), F.col("root"), F.col("affix"), F.col("affix_type")
    values = {"affix_type": kind, "affix": affix, "root": root}
    near = F.filter(F.array(F.col("count") - 1, F.col("count") + 1, F.col("count") + 2, F.col("count") - 2), lambda x: x > 0)
    related = related_words(rows, out.select("word"), seed=seed)
    applied = out.join(related, ["word", "affix_type", "affix"], "left")
    plain = F.concat(affix, root)
    distractors = F.slice(F.concat(_three(F.coalesce("related", F.array().cast(STRINGS)), w, seed, w), F.array_repeat(plain, 3)), 1, 3)
    parts = [
        _level(out, 2, "morphology", "affix_identification", affix, _three(F.col("pool"), affix, f"{seed}-id", w) if mcq else None, values, F.concat(F.lit("affix_identification_"), kind)),
        _level(out, 2, "morphology", "root_extraction", root, _three(F.col("others"), root, f"{seed}-root", w) if mcq else None, values),
        _level(out, 2, "morphology", "syllable_counting", F.col("count"), F.slice(near, 1, 3) if mcq else None, values),
        _level(out, 3, "decomposition", "affix_removal", root, _three(F.concat(F.col("others"), F.array(w)), root, f"{seed}-rem", w) if mcq else None, values, F.concat(F.lit("affix_removal_"), kind)),
        _level(applied, 4, "composition", "affix_application", w, distractors if mcq else None, values, F.concat(F.lit("affix_application_"), kind)),
        multi_step(rows, n, mcq, seed),
    ]
    return union(parts)


def related_words(rows: DataFrame, wanted: DataFrame, most: int = 20, seed: int = 42) -> DataFrame:
    """(word, affix_type, affix, related): up to ``most`` other words with the same root, or the same affix of a type.

    Each root and affix of the wanted words has a sketch of its least words in a seeded order, of
    which any word of the group may be one; of both sketches the least are taken. A frequent affix
    is sketched in parts, so neither its words nor their pairs come together.
    """
    order = order_key(f"{seed}-related", F.col("word"))
    own = materialize(rows.join(wanted.select("word").distinct(), "word", "left_semi").select("word", "affix_type", "affix", "root"), "wanted-words")
    found = []
    for keys in (["root"], ["affix_type", "affix"]):
        asked = own.select(*keys).distinct()
        sketches = least_of_each(rows.join(asked, keys, "left_semi"), most + 1, keys, "word", order)
        found.append(own.join(sketches, keys).select("word", "affix_type", "affix", F.explode("items").alias("other")))
    both = union(found).where("other <> word")
    least = both.groupBy("word", "affix_type", "affix").agg(F.slice(F.array_sort(F.collect_set(F.struct(order_key(f"{seed}-related", F.col("other")).alias("k"), "other"))), 1, most).alias("least"))
    return least.select("word", "affix_type", "affix", F.array_sort(F.transform("least", lambda x: x["other"])).alias("related"))


def multi_step(rows: DataFrame, n: int | None, mcq: bool, seed: int) -> DataFrame:
    """The root of one word with the prefix or suffix of the next, joined plainly."""
    from ..operators.ordering import with_row_index

    usable = rows.where(F.col("prefix").isNotNull() | F.col("suffix").isNotNull()).select("word", "root", "prefix", "suffix")
    usable = usable.withColumn("_order", order_key(f"{seed}-pairs", F.col("word")))
    if n is not None:  # no more than these make pairs that are kept
        usable = usable.orderBy("_order", "word").limit(2 * n)
    ordered = with_row_index(usable, "_order", "word")
    pair = F.floor(F.col("row_index") / 2)
    one = ordered.where("row_index % 2 = 0").select(pair.alias("pair"), "word", "root")
    kind = F.when(F.col("prefix").isNotNull(), "prefix").otherwise("suffix")
    two = ordered.where("row_index % 2 = 1").select(pair.alias("pair"), kind.alias("affix_type"), F.coalesce("prefix", "suffix").alias("affix"), F.col("root").alias("other_root"))
    both = first(one.join(two, "pair"), n, F.col("pair"))
    root, affix, prefix = F.col("root"), F.col("affix"), F.col("affix_type") == "prefix"
    joined = lambda r: F.when(prefix, F.concat(affix, r)).otherwise(F.concat(r, affix))
    answer = joined(root)
    wrong = F.slice(F.filter(F.array(joined(F.col("other_root")), F.when(prefix, F.concat(root, affix)).otherwise(F.concat(affix, root)), joined(F.col("word")), root), lambda x: x != answer), 1, 3)
    return _level(both, 5, "reasoning", "multi_step", answer, wrong if mcq else None, {"affix_type": F.col("affix_type"), "affix": affix})


# --- language games and sums -----------------------------------------------------------------


MOST_WORDS = 100_000


def language_games(words: DataFrame, game: str, n: int, options: int = 4, seed: int = 0) -> DataFrame:
    """``n`` questions (id, question, answer, options): the right word comes first in ``options``.

    ``words`` is a word list of bounded size, at most MOST_WORDS; it is held as one broadcast array.
    """
    if words.limit(MOST_WORDS + 1).count() > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words for a game; choose the most frequent")
    listed = words.agg(F.array_sort(F.collect_set("word")).alias("all"))
    base = words.sparkSession.range(n).crossJoin(F.broadcast(listed))  # one row of words
    i = F.col("id")
    mixed = base.withColumn("all", shuffled(F.col("all"), seed, i))
    letter = F.substr(F.lit(chars.ALPHABET), (F.pmod(number(f"{seed}-l", i), F.lit(26)) + 1).cast("int"), F.lit(1))
    head = F.get("all", F.lit(0))
    span = (F.pmod(number(f"{seed}-n", i), F.least(F.lit(3), F.length(head))) + 1).cast("int")
    start = (F.pmod(number(f"{seed}-s", i), F.length(head) - span + 1) + 1).cast("int")
    aux = {"most": letter, "contains": F.substr(head, start, span), "starts": F.substr(head, F.lit(1), span), "ends": F.substr(head, F.length(head) - span + 1, span)}.get(game, F.lit(""))
    fits = {
        "most": (lambda w: chars.count_char(w, F.col("aux")) >= 2, lambda w: chars.count_char(w, F.col("aux")) <= 1),
        "contains": (lambda w: F.contains(w, F.col("aux")), lambda w: ~F.contains(w, F.col("aux"))),
        "starts": (lambda w: F.startswith(w, F.col("aux")), lambda w: ~F.startswith(w, F.col("aux"))),
        "ends": (lambda w: F.endswith(w, F.col("aux")), lambda w: ~F.endswith(w, F.col("aux"))),
        "longest": (lambda w: F.length(w) >= 7, lambda w: F.length(w) <= 4),
        "shortest": (lambda w: F.length(w) <= 3, lambda w: F.length(w) >= 6),
    }[game]
    # Generated rows keep later filters from being pushed below, where they would repeat the shuffle for each word.
    ready = mixed.withColumn("aux", aux).select(F.inline(F.array(F.struct("id", "all", "aux"))))
    made = ready.select("id", "aux", F.get(F.filter("all", fits[0]), F.lit(0)).alias("answer"), F.slice(F.filter("all", fits[1]), 1, options - 1).alias("wrong"))
    made = made.select(F.inline(F.array(F.struct("id", "aux", "answer", "wrong"))))
    made = made.where(F.col("answer").isNotNull() & (F.size("wrong") == options - 1)).withColumn("options", F.concat(F.array("answer"), F.col("wrong")))
    choose = lambda xs, tag: pick(F.array(*[F.lit(x) for x in xs]), number(f"{seed}-{tag}", F.col("id")))
    fill = lambda t: F.replace(F.replace(F.replace(t, F.lit("<OPTIONS>"), choose(prompts.OPTIONS, "os")), F.lit("<OPTION>"), choose(prompts.OPTION, "o")), F.lit("<THE>"), choose(prompts.THE, "t"))
    upper_first = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))
    asked = F.concat(upper_first(fill(choose(prompts.GAME_OPENINGS, "q"))), F.lit(" "), F.replace(F.lit(prompts.GAMES[game]), F.lit("<AUX>"), F.col("aux")))
    turn = F.pmod(number(f"{seed}-r", F.col("id")), F.lit(options)).cast("int")
    turned = F.concat(F.slice("options", turn + 1, F.lit(options)), F.slice("options", F.lit(1), turn))
    listing = F.concat(upper_first(fill(choose(prompts.GAME_LISTS, "ls"))), F.lit(" [ "), F.array_join(turned, ", "), F.lit("]."))
    order = F.pmod(number(f"{seed}-ord", F.col("id")), F.lit(2)) == 0
    question = F.concat(F.when(order, F.concat(asked, F.lit(" "), listing)).otherwise(F.concat(listing, F.lit(" "), asked)), F.lit(" Answer:"))
    return made.select("id", question.alias("question"), "answer", "options", "aux")


def game_training(games: DataFrame, encode, end_id: int, train: int) -> DataFrame:
    """Training rows of ``games`` (id, question, answer): ids padded to the longest, and where the answer stands.

    ``encode`` is a column function from text to ids. (split, id, ids, idxs_for_masks): the places 0,
    end of the question and end of the answer. The first ``train`` ids are the training split.
    """
    from ..functions.tokens import pad_truncate

    rows = games.select("id", encode(F.col("question")).alias("_q"), encode(F.col("answer")).alias("_a"))
    rows = materialize(rows, "game-ids")
    longest = rows.agg(F.max(F.size("_q") + F.size("_a"))).first()[0] or 0
    places = F.array(F.lit(0), F.size("_q"), F.size("_q") + F.size("_a"))
    split = F.when(F.col("id") < train, "train").otherwise("val")
    return rows.select(split.alias("split"), "id", pad_truncate(F.concat("_q", "_a"), longest, end_id).alias("ids"), places.alias("idxs_for_masks"))


def sum_training(questions: DataFrame, encode) -> DataFrame:
    """``questions`` of ``sums`` as ids: whole texts, and character by character.

    (split, pair, question, answer, ids, character_ids). The text is ``$question`` and the answer
    reversed; the batched expansion of the ``ids`` stream is ``ordering.stream_batches`` with
    ``expand.expand_batches``, and ``question_answers`` cuts any of the three streams again.
    """
    text = F.concat(F.lit("$"), F.col("question"), F.col("reversed_answer"))
    letters = F.flatten(F.transform(F.split("_text", ""), lambda c: F.element_at(F.col("_map"), c)))
    alphabet = [*"0123456789+=$"]
    table = questions.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, alphabet))).alias("c")).select("c", encode(F.col("c")).alias("ids"))
    known = table.agg(F.map_from_entries(F.collect_list(F.struct("c", "ids"))).alias("_map"))  # one row, thirteen characters
    rows = questions.withColumn("_text", text).crossJoin(F.broadcast(known))
    return rows.select("split", "pair", F.concat(F.lit("$"), F.col("question")).alias("question"), F.col("reversed_answer").alias("answer"), encode(F.col("_text")).alias("ids"), letters.alias("character_ids"))


def question_answers(ids: Column, equals_id: int, dollar_id: int) -> Column:
    """A stream of ids cut at its equals and dollar signs: structs (question with both signs, answer), in order."""
    at = F.filter(F.transform(ids, lambda x, i: F.when(x == dollar_id, i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(ids)))
    whole = F.transform(F.arrays_zip(at.alias("a"), ends.alias("b")), lambda p: F.slice(ids, p["a"] + 1, p["b"] - p["a"]))
    cut = lambda xs: F.array_position(xs, equals_id).cast("int")
    return F.transform(F.filter(whole, lambda xs: cut(xs) > 0), lambda xs: F.struct(F.slice(xs, F.lit(1), cut(xs)).alias("question"), F.slice(xs, cut(xs) + 1, F.size(xs)).alias("answer")))


def sums(spark, digits: int, train: int, val: int, seed: int = 0) -> DataFrame:
    """Questions a+b= over numbers of ``digits`` digits without repeats, split into train and val."""
    lo, hi = 10 ** (2 * digits - 1), 10 ** (2 * digits)
    if train + val > hi - lo:
        raise ValueError(f"{train + val} questions asked, {hi - lo} pairs there are")
    pairs = spark.range(lo, hi).orderBy(F.pmod(F.col("id") * 48271 + seed, F.lit(2147483647)), "id").limit(train + val)
    from ..operators.ordering import with_row_index

    placed = with_row_index(pairs.withColumn("_order", F.pmod(F.col("id") * 48271 + seed, F.lit(2147483647))), "_order", "id")
    a, b = F.floor(F.col("id") / 10**digits), F.col("id") % 10**digits
    total = (a + b).cast("string")
    return placed.select(
        F.col("id").alias("pair"),
        F.concat(a.cast("string"), F.lit("+"), b.cast("string"), F.lit("=")).alias("question"),
        total.alias("answer"),
        F.reverse(total).alias("reversed_answer"),
        F.when(F.col("row_index") < train, "train").otherwise("val").alias("split"),
    )


def sum_options(questions: DataFrame, seed: int = 0) -> DataFrame:
    """``questions`` with three distinct wrong answers: near misses, and slips of digits and carries."""
    x = F.col("answer").cast("bigint")
    s = F.col("answer")
    k = number(seed, s)
    candidates = F.array(
        (x + 1 + k % 20).cast("string"),
        (x - 1 - k % 20).cast("string"),
        F.reverse(s),
        F.when(F.length(s) > 1, F.substr(s, F.lit(1), F.length(s) - 1)).otherwise((x * 10).cast("string")),
        F.concat(s, (k % 10).cast("string")),
        F.when(x % 10 < 5, (x + 10).cast("string")).otherwise((x - 10).cast("string")),
        F.when(x >= 100, (x + 100).cast("string")).otherwise((x + 10).cast("string")),
        (x + 21 + k % 29).cast("string"),
        (x + 51).cast("string"),
        (x + 52).cast("string"),
    )
    good = F.array_distinct(F.filter(candidates, lambda c: (c != s) & c.rlike("^[1-9][0-9]*$")))
    return questions.withColumn("wrong", F.slice(shuffled(good, seed, s), 1, 3))
