"""Randomized expansion and contraction of token sequences.

Each edit changes the positions of the next, so a sequence is edited in Python, in Arrow batches.
Draws are counted: the number of a step is a hash of (seed, row key, edit, step, purpose), so results
do not depend on partitions, order or retries, and SQL can make the same ones. The places an edit
may choose from are kept in ``places``, so a step takes the logarithm of the length.

Tables of pairs are either broadcast whole (``Tables.collect``), for vocabularies of up to
``Tables.MOST`` tokens and pairs, or, for vocabularies of any size, joined to the rows: an edit keeps
a row's bytes, so ``with_known`` gives each row the tokens and affix versions that are byte runs of it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..working import materialize
from .places import Places

IDS = T.ArrayType(T.IntegerType())


#: How byte-level vocabularies cut a text before they merge: words, numbers and marks with the space before them. A fixed value.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Draws:
    """Numbers from 0 to 2^32 - 1, each a function of its name alone, as ``functions.seeded.number`` makes them."""

    def __init__(self, *names: object):
        self.name = "|".join(map(str, names))

    def named(self, name: object) -> Draws:
        return Draws(self.name, name)

    def number(self, step: int, what: str) -> int:
        return int(hashlib.md5(f"{self.name}|{step}|{what}".encode(), usedforsecurity=False).hexdigest()[:8], 16)

    def chance(self, step: int, what: str, share: float) -> bool:
        return self.number(step, what) < share * (1 << 32)


def generator(seed: int, key: object) -> Draws:
    return Draws(seed, key)


class Tables:
    """Pairs of a vocabulary, as plain dictionaries for the workers."""

    def __init__(self, expansions: dict[int, list[tuple[int, int]]], tokens: dict[int, bytes], affixes: list[str] = (), pattern: str = PIECES):  # noqa: B006
        self.expansions, self.tokens, self.pattern = expansions, tokens, pattern
        self.contractions = {pair: t for t, pairs in expansions.items() for pair in pairs}
        self.ids = {t: i for i, t in tokens.items()}
        self.affixes = sorted(set(affixes))
        self.affix_ids = {self.ids[a.encode()] for a in self.affixes if a.encode() in self.ids}
        self._finder = self._cut = None
        self._known: dict[str, list[int] | None] = {}

    #: Tokens, expandable tokens and affix versions that are collected and shared with every task, at most.
    MOST = 2_000_000

    @classmethod
    def collect(cls, expansions: DataFrame, vocab: DataFrame, versions: DataFrame | None = None, pattern: str = PIECES) -> Tables:
        """The tables on the driver: one row a token. More than MOST tokens, pairs or affix versions are an error."""
        vocab, expansions = materialize(vocab.select("token_id", "token"), "vocabulary"), materialize(expansions.select("token_id", "pairs"), "expansions")
        pairs_each = expansions.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0]
        if max(vocab.count(), pairs_each) > cls.MOST:
            raise ValueError(f"a vocabulary of more than {cls.MOST} tokens or pairs can't be shared with every task; join it to the rows by with_known")
        pairs = {r.token_id: [(p.left, p.right) for p in r.pairs] for r in expansions.select("token_id", "pairs").collect()}
        tokens = {r.token_id: bytes(r.token) for r in vocab.select("token_id", "token").collect()}
        affixes = [r.version for r in versions.select("version").distinct().limit(cls.MOST + 1).collect()] if versions is not None else []
        if len(affixes) > cls.MOST:
            raise ValueError(f"more than {cls.MOST} affix versions can't be shared with every task")
        return cls(pairs, tokens, affixes, pattern)

    @classmethod
    def of(cls, known: list[dict] | None, pattern: str = PIECES) -> Tables:
        """The part of the tables that one row needs, from its ``known``; a token's pairs are all two tokens that make it up."""
        tokens = {e["token_id"]: e["token"] for e in known or () if e["token_id"] is not None}
        named = defaultdict(list)
        for i, t in tokens.items():
            named[t].append(i)
        pairs = {i: sorted((a, b) for k in range(1, len(t)) for a in named.get(t[:k], ()) for b in named.get(t[k:], ())) for i, t in tokens.items()}
        return cls({i: p for i, p in pairs.items() if p}, tokens, [e["token"].decode() for e in known or () if e["is_affix"]], pattern)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 come as lone surrogates, which ``encode`` turns back."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "surrogateescape")

    def encode(self, text: str) -> list[int] | None:
        """Ids by merging in rank order within the pieces of the text; null if a byte of it is no token."""
        if self._cut is None:
            import regex

            self._cut = regex.compile(self.pattern).findall
        out: list[int] = []
        for piece in self._cut(text):
            if piece not in self._known:
                if len(self._known) >= 200_000:
                    self._known.clear()
                self._known[piece] = self.merge(piece.encode("utf-8", "surrogateescape"))
            if (ids := self._known[piece]) is None:
                return None
            out += ids
        return out

    def merge(self, data: bytes) -> list[int] | None:
        """Starts from single bytes and merges, again and again, the leftmost pair of the least token id.

        The pairs wait in a heap, and the parts are a linked list, so long pieces take no square.
        """
        if any(data[i : i + 1] not in self.ids for i in range(len(data))):
            return None
        n = len(data)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ids.get(data[i : end[j]])) is not None:
                heapq.heappush(waiting, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while waiting:
            _, i, stop = heapq.heappop(waiting)
            if gone[i] or after[i] >= n or end[after[i]] != stop or end[i] == stop:
                continue
            j = after[i]
            gone[j], end[i], after[i] = True, stop, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ids[data[i : end[i]]] for i in range(n) if not gone[i]]

    def find(self, text: str) -> list[tuple[int, str]]:
        """All occurrences of all affix versions, overlapping ones too: (start, version)."""
        if not self.affixes:
            return []
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for a in self.affixes:
                self._finder.add_word(a, a)
            self._finder.make_automaton()
        return [(end - len(a) + 1, a) for end, a in self._finder.iter(text)]

    def __getstate__(self):
        return {**self.__dict__, "_finder": None, "_cut": None, "_known": {}}


def _count_matches(batches, affixes):
    finder = Tables({}, {}, affixes)
    for batch in batches:
        docs, places = Counter(), Counter()
        for text in batch.column(0):
            found = [a for _, a in finder.find(text.as_py() or "")]
            places.update(found)
            docs.update(set(found))
        names = list(places)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([docs[a] for a in names], pa.int64()), pa.array([places[a] for a in names], pa.int64())], ["affix", "n_docs", "n_matches"])


def affix_matches(rows: DataFrame, text: str, affixes: DataFrame) -> DataFrame:
    """(affix, n_docs, n_matches): rows that have an affix and all its places, overlapping ones too, in one pass.

    One automaton finds all affixes at once. The list goes to every task; more than ``Tables.MOST``
    are an error. Counts are added up in each batch before they are shuffled.
    """
    listed = sorted({r.affix for r in affixes.select("affix").distinct().limit(Tables.MOST + 1).collect() if r.affix})
    if len(listed) > Tables.MOST:
        raise ValueError(f"more than {Tables.MOST} affixes can't be shared with every task")
    counted = rows.select(text).mapInArrow(partial(_count_matches, affixes=listed), "affix string, n_docs long, n_matches long")
    return counted.groupBy("affix").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_matches").alias("n_matches"))


def expand(ids: list[int], tables: Tables, draws: Draws, share: float = 0.1, most: int | None = None, skip_affixes: bool = False) -> list[int]:
    """int(n * share) tries at a place of the current list; an expandable id becomes one of its pairs.

    With ``skip_affixes`` only places without an affix id are tried; it ends when there are none.
    """
    skipped = tables.affix_ids if skip_affixes else frozenset()
    places, done = Places(ids, lambda a, _: int(a not in skipped), 1), 0
    for step in range(int(len(ids) * share)):
        if most and done >= most or not (n := places.count(0)):
            break
        at = places.find(0, draws.number(step, "at") % n)
        if pairs := tables.expansions.get(places.following(*at, 1)[0]):
            places.replace(*at, 1, list(pairs[draws.number(step, "pair") % len(pairs)]))
            done += 1
    return places.ids()


def expand_batches(spark: SparkSession, batches: DataFrame, tables: Tables, seed: int = 0, share: float = 1.0) -> DataFrame:
    """``batches`` (batch, ids) of ``ordering.stream_batches``, each expanded on its own: as many tries as ids, for ``share`` 1.

    Concatenated by batch they are the expanded stream. A batch is one row, so a task holds a few.
    """
    run = per_row(spark, tables, expand, seed, share=share)
    return batches.select("batch", run(F.col("batch"), F.col("ids")).alias("ids"))


def contract(ids: list[int], tables: Tables, draws: Draws, share: float = 0.1) -> list[int]:
    """int(n * share) tries at a random neighbouring pair, merged if the pair is a token."""
    places = Places(ids, lambda _, b: int(b is not None), 1)
    for step in range(int(len(ids) * share)):
        if not (n := places.count(0)):
            break
        at = places.find(0, draws.number(step, "at") % n)
        if (merged := tables.contractions.get(tuple(places.following(*at, 2)))) is not None:
            places.replace(*at, 2, [merged])
    return places.ids()


def selective_expand(ids: list[int], tables: Tables, draws: Draws, share: float = 0.3) -> list[int]:
    """Only expandable places are tried, those without an affix id first; it ends when there are none."""

    def kinds(a: int, _: int | None) -> int:
        return 0 if a not in tables.expansions else 1 if a in tables.affix_ids else 3

    places = Places(ids, kinds, 2)
    for step in range(int(len(ids) * share)):
        kind = 1 if places.count(1) else 0
        if not (n := places.count(kind)):
            break
        at = places.find(kind, draws.number(step, "at") % n)
        pairs = tables.expansions[places.following(*at, 1)[0]]
        places.replace(*at, 1, list(pairs[draws.number(step, "pair") % len(pairs)]))
    return places.ids()


def affix_contract(ids: list[int], tables: Tables, draws: Draws, share: float = 0.3, preference: float = 0.7) -> list[int]:
    """Contractible pairs only; with chance ``preference`` one that forms an affix, if there is one."""

    def kinds(a: int, b: int | None) -> int:
        merged = tables.contractions.get((a, b))
        return 0 if merged is None else 3 if merged in tables.affix_ids else 1

    places = Places(ids, kinds, 2)
    for step in range(int(len(ids) * share)):
        if not places.count(0):
            break
        kind = 1 if places.count(1) and draws.chance(step, "prefer", preference) else 0
        at = places.find(kind, draws.number(step, "at") % places.count(kind))
        places.replace(*at, 2, [tables.contractions[tuple(places.following(*at, 2))]])
    return places.ids()


def cycles(ids: list[int], tables: Tables, draws: Draws, n: int = 3, expand_share: float = 0.3, contract_share: float = 0.3, preference: float = 0.7) -> list[int]:
    for i in range(n):
        ids = affix_contract(selective_expand(ids, tables, draws.named(2 * i), expand_share), tables, draws.named(2 * i + 1), contract_share, preference)
    return ids


#: How many tokens a run has and how often, tries at a run, and the chances to pass over or cut at affixes.
RUNS, RUN_SHARES, TRIES = (2, 3, 4), (0.35, 0.7, 1.0), 100
AWARE, AWARE_OVERLAP = 0.95, 0.75


def _split_affix(text: str, tables: Tables, draws: Draws, step: int, awareness: float) -> list[str]:
    matches = sorted(tables.find(text))
    if not matches or not draws.chance(step, "cut", awareness):
        return [text]
    among = [m for m in matches if " " in m[1]] or matches
    at, affix = among[draws.number(step, "affix") % len(among)]
    return [p for p in (text[:at], affix, text[at + len(affix) :]) if p]


def split_pair(text: str) -> list[str]:
    """At the first doubled pair of characters: what is before, the pair, the rest without one pair."""
    for i in range(len(text) - 3):
        if text[i : i + 2] == text[i + 2 : i + 4]:
            return [p for p in (text[:i], text[i : i + 2], text[i + 2 :]) if p]
    return [text]


def contract_expand(
    ids: list[int], tables: Tables, draws: Draws, contract_share: float = 0.9, expand_share: float = 0.1, awareness: float = AWARE, awareness_overlap: float = AWARE_OVERLAP, bounds: frozenset[int] = frozenset()
) -> list[int]:
    """Runs of two to four tokens are decoded, cut at affixes and doubled pairs, and encoded again by merging.

    A run with an affix id is passed over with chance ``awareness``; ids in ``bounds`` are avoided.
    Then other tokens are expanded. The input list is not changed, and no byte is lost: a run with a
    byte that is no token of its own stays as it is.
    """
    places = Places(ids, lambda _a, _b: 1, 1)
    for step in range(int(len(ids) * contract_share)):
        if not (size := places.count(0)):
            break
        share = draws.number(step, "run") / (1 << 32)
        n = min(size, next(r for r, edge in zip(RUNS, RUN_SHARES, strict=True) if share < edge))
        at = places.find(0, 0)
        for k in range(TRIES if size > n else 0):
            place = places.find(0, draws.number(step, f"start{k}") % (size - n + 1))
            run = places.following(*place, n)
            if bounds and bounds.intersection(run):
                continue
            starts = [i for i, _ in tables.find(tables.decode(run))]
            keep = awareness_overlap if len(starts) != len(set(starts)) else awareness
            if not tables.affix_ids.intersection(run) or not draws.chance(step, f"keep{k}", keep):
                at = place
                break
        pieces = _split_affix(tables.decode(places.following(*at, n)), tables, draws, step, awareness)
        parts = [tables.encode(q) for p in pieces for q in split_pair(p)]
        if None not in parts:
            places.replace(*at, n, [i for part in parts for i in part])
    return expand(places.ids(), tables, draws.named("expand"), expand_share, skip_affixes=True)


def per_row(spark: SparkSession, tables: Tables, edit: Callable[..., list[int]], seed: int = 0, **options) -> Callable[[Column, Column], Column]:
    """A column function (key, ids) -> edited ids; null ids stay null."""
    shared = spark.sparkContext.broadcast(tables)

    @F.pandas_udf(IDS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for keys, ids in batches:
            yield pd.Series([None if x is None else edit(list(map(int, x)), shared.value, generator(seed, k), **options) for k, x in zip(keys, ids, strict=True)])

    return run


def text_encoder(spark: SparkSession, tables: Tables) -> Callable[[Column], Column]:
    """A column function text -> ids by the vocabulary's merges; a text with a byte that is no token is an error."""
    shared = spark.sparkContext.broadcast(tables)

    def ids(text: str) -> list[int]:
        if (found := shared.value.encode(text)) is None:
            raise ValueError(f"a byte of {text[:60]!r} is no token of the vocabulary")
        return found

    @F.pandas_udf(IDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else ids(t) for t in texts])

    return run


def text_decoder(spark: SparkSession, tables: Tables) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(tables)

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([None if x is None else shared.value.decode(list(map(int, x))).encode("utf-8", "surrogateescape").decode("utf-8", "replace") for x in ids])

    return run


def entries(vocab: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(token, token_id, is_affix): the tokens and the affix versions by their bytes, written once; a version that is no token has no id."""
    made = vocab.select("token", "token_id")
    if versions is None:
        return materialize(made.withColumn("is_affix", F.lit(False)), "entries")
    named = versions.select(F.encode("version", "UTF-8").alias("token"), F.lit(True).alias("is_affix")).distinct()
    return materialize(made.join(named, "token", "full").select("token", "token_id", F.coalesce("is_affix", F.lit(False)).alias("is_affix")), "entries")


def _with_runs(rows: DataFrame, key: Column, pieces: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` with ``known``: the entries that are byte runs of the row's ``pieces`` (key, piece).

    Runs are as long as the longest entry at most, and each is looked up by an equi-join. Keys are
    hashes: rows that share one share its runs, and an entry that a row has not changes nothing.
    """
    longest = listed.agg(F.max(F.octet_length("token"))).first()[0] or 0
    size = F.octet_length("piece")
    starts = pieces.where(size > 0).distinct().select("key", "piece", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("at") + 1))
    runs = starts.select("key", F.explode(F.transform(sizes, lambda n: F.substr("piece", F.col("at"), n))).alias("token")).distinct()
    known = runs.join(listed, "token").groupBy("key").agg(F.collect_list(F.struct("token", "token_id", "is_affix")).alias("known"))
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), key.alias("key"))
    return keyed.join(known, "key", "left").select("row.*", "known")


def with_known(rows: DataFrame, text: Column, listed: DataFrame) -> DataFrame:
    """``rows`` with ``known``: the ``entries`` that occur in the bytes of ``text``."""
    key = F.xxhash64(text)
    return _with_runs(rows, key, rows.select(key.alias("key"), F.encode(text, "UTF-8").alias("piece")), listed)


def with_known_of_ids(rows: DataFrame, ids: Column, listed: DataFrame) -> DataFrame:
    """``rows`` with ``known``: the ``entries`` that occur within single tokens of ``ids``, all that expansions need."""
    key = F.xxhash64(ids)
    named = rows.select(key.alias("key"), F.explode(F.array_distinct(ids)).alias("token_id")).distinct()
    return _with_runs(rows, key, named.join(listed, "token_id").select("key", F.col("token").alias("piece")), listed)


def _by_row(run: Callable, kind: T.DataType, arrow: pa.DataType) -> Callable[..., Column]:
    """A column function of ``run`` on the values of a row."""

    @F.arrow_udf(kind)
    def column(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([run(*(x.as_py() for x in row)) for row in zip(*batch, strict=True)], arrow)

    return column


def known_encoder(pattern: str = PIECES) -> Callable[[Column, Column], Column]:
    """A column function (text, known) -> ids, as ``text_encoder`` gives them."""

    def ids(text: str | None, known: list[dict] | None) -> list[int] | None:
        if text is not None and (found := Tables.of(known, pattern).encode(text)) is None:
            raise ValueError(f"a byte of {text[:60]!r} is no token of the vocabulary")
        return None if text is None else found

    return _by_row(ids, IDS, pa.list_(pa.int32()))


def known_edit(edit: Callable[..., list[int]], seed: int = 0, pattern: str = PIECES, **options) -> Callable[[Column, Column, Column], Column]:
    """A column function (key, ids, known) -> edited ids, as ``per_row`` gives them."""

    def edited(key: object, ids: list[int] | None, known: list[dict] | None) -> list[int] | None:
        return None if ids is None else edit(ids, Tables.of(known, pattern), generator(seed, key), **options)

    return _by_row(edited, IDS, pa.list_(pa.int32()))


def expand_known_batches(batches: DataFrame, listed: DataFrame, seed: int = 0, share: float = 1.0) -> DataFrame:
    """``batches`` expanded as ``expand_batches`` does, by the ``entries`` joined to them."""
    run = known_edit(expand, seed, share=share)
    return with_known_of_ids(batches, F.col("ids"), listed).select("batch", run(F.col("batch"), F.col("ids"), F.col("known")).alias("ids"))


def known_decoder() -> Callable[[Column, Column], Column]:
    """A column function (ids, known) -> text, as ``text_decoder`` gives it."""

    def text(ids: list[int] | None, known: list[dict] | None) -> str | None:
        if ids is None:
            return None
        tokens = {e["token_id"]: e["token"] for e in known or ()}
        return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")

    return _by_row(text, T.StringType(), pa.string())
