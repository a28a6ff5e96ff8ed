"""Conversation structure repair: the cheapest edits that make a conversation (system?) (user assistant)*.

Rows are damaged first, as a test of the repair, or come damaged. The repair is a least-cost path:
each row is kept, given another role or deleted, and empty rows may be inserted, until the roles
read ``(s?(ua)+)?``. What this costs depends on a conversation's signature alone, one symbol a row:
its role's initial and whether it is whole, truncated or must go. The method is a trie-shared DP:

1. Signatures are sorted and so inserted into a prefix trie, rightmost path first held as a stack.
   A signature is written from the last row to the first, so that a prefix is a conversation's end.
2. A node's DP layer holds, for each state of the role pattern, the least cost to finish from there.
   It is computed once for all signatures that share the prefix.
3. At a terminal node the answer is read off the path back to the root, which is the conversation
   from its first row on: the least edit in ASCII order that keeps the least cost, so ties are exact.

Equal rows are one row with a count before anything is shuffled, and repeats are found by a least
turn, not by a window. A conversation's rows then pass one task in order, as a stream: signatures have
a byte a row, texts are hashed as they pass and never held. That a conversation is one stream is due
to the digest of its whole repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A letter that is no white space, and how a whole text ends.
LETTER, ENDS = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
FAR = 1 << 60
#: States: nothing yet, after the system row, after a user row, after an assistant row; only the first and last may end.
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: What a given role or an inserted row is in each state.
GIVEN = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
FIRST: tuple[int, int, int, int] = (0, FAR, FAR, 0)


def _inserting(least: list[int]) -> tuple[int, ...]:
    """The costs to finish with rows inserted first; at most three are of use."""
    for _ in range(3):
        least = [min(least[q], INSERT + least[STEP[GIVEN[q]][q]]) for q in range(4)]
    return tuple(least)


def layer(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """The costs to finish from each state before a row, from those after it.

    ``symbol``: d for a row that must go, else the role's initial (x for another one), upper case if truncated.
    """
    out = []
    extra = TRUNCATED if symbol.isupper() else 0
    for q in range(4):
        costs = [DELETE + after[q]]
        if symbol != "d":
            costs.append(REROLE + extra + after[STEP[GIVEN[q]][q]])
            kept = STEP.get(symbol.lower(), (None,) * 4)[q]
            if kept is not None:
                costs.append(KEEP + extra + after[kept])
        out.append(min(costs))
    return _inserting(out)


LAST = _inserting(list(FIRST))


def edits(signature: str, layers: list[tuple[int, ...]]) -> str:
    """The least edits in ASCII order; ``layers[k]``: costs before the last k rows."""
    q, out, i = 0, [], len(signature)
    while i or layers[0][q] != FIRST[q]:
        cost, given = layers[i][q], STEP[GIVEN[q]][q]
        if i:
            symbol, after = signature[i - 1], layers[i - 1]
            extra = TRUNCATED if symbol.isupper() else 0
            if cost == DELETE + after[q]:
                out.append("D")
                i -= 1
                continue
        if cost == INSERT + layers[i][given]:
            out.append("I")
            q = given
            continue
        kept = STEP.get(symbol.lower(), (None,) * 4)[q]
        if kept is not None and cost == KEEP + extra + after[kept]:
            out.append("K")
            q = kept
        else:
            out.append("R")
            q = given
        i -= 1
    return "".join(out)


def solved(signatures: Iterator[str]) -> Iterator[tuple[int, str, int]]:
    """(cost, edits, layers computed) for sorted signatures, each the conversation's symbols from its last row to its first."""
    path, layers, answer = "", [LAST], None
    for signature in signatures:
        if answer is not None and signature == path:
            yield *answer, 0
            continue
        common = _common(path, signature)
        del layers[common + 1 :]
        for symbol in signature[common:]:
            layers.append(layer(symbol, layers[-1]))
        path, answer = signature, (layers[-1][0], edits(signature, layers))
        yield *answer, len(signature) - common


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the conversation after the edits; ``rows`` are all its rows in order."""
    q = 0
    for edit in audit:
        if edit == "I":
            role, text = NAMES[GIVEN[q]], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            role = NAMES[GIVEN[q]] if edit == "R" else role
        q = STEP[role[0]][q]
        yield role, text


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of ``rows``: n is how often the row is there after the damage, which follows the row's key."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, n) with ``fault`` of the first of the n rows: blank, duplicate, truncated or none.

    Rows are distinct after this. All repeats of a row within its turn have a fault: blank as the
    first, or duplicate.
    """
    once = materialize(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n")), "turns")
    key = ["conv_id", "role", F.xxhash64("text").alias("k"), F.xxhash64(F.lit(1), "text").alias("l")]
    # A null turn is first; only what comes at several turns has later ones, and is counted before it is shuffled.
    first = once.where("n > 0").groupBy(*key).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    first = materialize(first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("k").alias("k1"), F.col("l").alias("l1"), F.col("first.turn").alias("turn_first")), "first-turns")
    met = once.select("turn", "text", "n", *key).join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("k") == F.col("k1")) & (F.col("l") == F.col("l1")), "left")
    later = F.col("c").isNotNull() | F.col("r").isNotNull()
    later = later & F.col("turn").isNotNull() & (F.col("turn_first").isNull() | (F.col("turn") > F.col("turn_first")))
    fault = F.when(~F.col("text").rlike(LETTER), "blank").when(later, "duplicate").when(~F.col("text").rlike(ENDS), "truncated").otherwise("none")
    return materialize(met.select("conv_id", "turn", "role", "text", "n", fault.alias("fault")), "faults")


ORDER = ["conv_id", "turn", "role", "text"]
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal"]
LEGAL = ("su", "ua", "au")


class _Seen:
    """What a conversation's rows in order leave behind."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.counts, self.illegal = conv_id, [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0
        self.least = self.most = self.last = None
        self.turns = 0

    def add(self, turn, initial: str, fault: str, n: int) -> None:
        if not n:
            return
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.last = initial
        gone = fault in ("blank", "duplicate")
        self.counts["blank" if fault == "blank" else "duplicate"] += n if gone else n - 1
        self.counts["truncated"] += fault == "truncated"
        symbol = initial if initial in STEP else "x"
        self.symbols.append("d" * n if gone else (symbol.upper() if fault == "truncated" else symbol) + "d" * (n - 1))

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv_id, gaps, *self.counts.values(), self.illegal, "".join(self.symbols)[::-1]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _signed(batches):
    """Rows (conv_id, turn, initial, fault, n) in order to a row for each conversation."""
    seen, schema, out = None, None, []
    for batch in batches:
        if schema is None:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *((c, pa.int64()) for c in REPORT), ("signature", pa.string())])
        for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seen is None or seen.conv_id != conv_id:
                if seen is not None:
                    out.append(seen.row())
                seen = _Seen(conv_id)
            seen.add(*row)
        if len(out) > 1000:
            yield _batch(out, schema)
            out = []
    if seen is not None:
        yield _batch([*out, seen.row()], schema)


def _solve(batches):
    """Sorted (signature, row) with the answers; the trie's present path lives as long as the task."""
    rows: list = []

    def signatures():
        for batch in batches:
            rows.append(batch)
            yield from batch.column(0).to_pylist()

    answers, out = solved(signatures()), []
    for cost, audit, layers in answers:
        out.append((cost, audit, layers))
        if len(out) == rows[0].num_rows:
            batch, made = rows.pop(0), list(zip(*out, strict=True))
            arrays = [pa.array(x, kind) for x, kind in zip(made, (pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1].flatten(), *arrays], [*(f.name for f in batch.schema.field(1).type), "cost", "audit", "layers"])
            out = []
            while rows and not rows[0].num_rows:
                rows.pop(0)


def _apply(batches):
    """Rows (conv_id, audit, role, text, n) in order, each conversation's audit before its rows, to the repaired rows."""
    schema, out = None, []

    def runs():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def kept():
        ahead = next(stream, None)
        while ahead is not None:
            conv_id, audit = ahead[:2]
            ahead = None

            def rows(conv_id=conv_id):
                nonlocal ahead
                for row in stream:
                    if row[1] is not None:
                        ahead = row
                        return
                    for _ in range(row[4]):
                        yield row[2], row[3]

            left = rows()
            for place, (role, text) in enumerate(repaired_rows(audit, left)):
                yield conv_id, place, role, text
            for _ in left:  # dropped rows after the last
                pass
            if ahead is None:
                ahead = next(stream, None)

    first = next(batches, None)
    if first is None:
        return
    schema = pa.schema([("conv_id", first.schema.field(0).type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    whole = batches

    def chained():
        yield first
        yield from whole

    batches = chained()
    stream, size = runs(), 0
    for row in kept():
        out.append(row)
        size += len(row[3])
        if len(out) == 5000 or size > 1 << 24:
            yield _batch(out, schema)
            out, size = [], 0
    yield _batch(out, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of ``rows`` (conv_id, turn, role, text, n: how often the row is there).

    report: for each conv_id, null too, the counts gaps, blank, duplicate, truncated and illegal, the
    least cost, the edits as ``audit``, and how many DP layers its signature added. repaired: conv_id,
    place (from 0), role, text, of which each conversation's rows stand together in order in a partition.

    Rows go by turn, null first; rows of one turn by role and text in UTF-8 order. Null roles and texts
    are one space. A role without a known initial, or none, is never kept as it is. A row with n = 0
    counts for nothing but its conversation's being there. No rows, no rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    found = faults(rows.select("conv_id", "turn", space("role"), space("text"), "n"))
    dealt = found.repartition("conv_id")
    counts = ", ".join(f"{c} long" for c in REPORT)
    streamed = dealt.sortWithinPartitions(*ORDER).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "n")
    signed = materialize(streamed.mapInArrow(_signed, f"conv_id {kind}, {counts}, signature string"), "signatures")
    # Equal signatures may be in several tasks, so a frequent one isn't dealt to one.
    ranged = signed.repartitionByRange(F.substring("signature", 1, 64), "conv_id").sortWithinPartitions("signature")
    shown = ranged.select("signature", F.struct("conv_id", *REPORT).alias("row"))
    report = materialize(shown.mapInArrow(_solve, f"conv_id {kind}, {counts}, cost long, audit string, layers long"), "repairs")
    none = lambda c: F.lit(None).cast(dict(found.dtypes)[c]).alias(c)
    asked = report.select("conv_id", "audit", *[none(c) for c in ("turn", "role", "text", "n")])
    both = asked.unionByName(found.where("n > 0").drop("fault").withColumn("audit", F.lit(None).cast("string")))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER[1:])
    repaired = ordered.select("conv_id", "audit", "role", "text", "n").mapInArrow(_apply, f"conv_id {kind}, place long, role string, text string")
    return report, repaired


def _digest(batches):
    """Rows (conv_id, place, role, text), each conversation's together in order, to a SHA-256 for each."""
    conv_id, digest, schema, out = None, None, None, []
    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), ("repaired_sha256", pa.string())])
        for i, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place == 0:
                if digest is not None:
                    out.append((conv_id, digest.hexdigest()))
                conv_id, digest = i, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if len(out) > 1000:
            yield _batch(out, schema)
            out = []
    if digest is not None:
        yield _batch([*out, (conv_id, digest.hexdigest())], schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """The report of ``repair`` with the SHA-256 of each repaired conversation: role:text, newline-joined."""
    report, repaired = repair(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    digests = repaired.mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    joined = report.join(digests, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return joined.select("conv_id", *REPORT, "cost", "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(read(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same in DuckDB: the damage and its faults, and the repair as a forward DP over each conversation.

    A state's value is cost (9 digits), edits, a character 1 and the repaired text; the least string is
    the cheapest, then the ASCII-least.
    """

    def more(value: str, cost: str, edit: str, line: str | None) -> str:
        at = f"strpos({value}, chr(1))"
        text = f"substr({value}, {at})"
        added = text if line is None else f"{text} || CASE WHEN length({text}) > 1 THEN chr(10) ELSE '' END || {line}"
        return f"lpad((substr({value}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({value}, 10, {at} - 10) || '{edit}' || {added}"

    def inserted(columns: list[str]) -> list[str]:
        q0, q1, q2, q3 = columns
        return [q0, q1, f"least({q2}, {more(q0, '5', 'I', chr(39) + 'user:' + chr(39))}, {more(q1, '5', 'I', chr(39) + 'user:' + chr(39))}, {more(q3, '5', 'I', chr(39) + 'user:' + chr(39))})", f"least({q3}, {more(q2, '5', 'I', chr(39) + 'assistant:' + chr(39))})"]

    def kept(q: str, initial: str) -> str:
        return f"CASE WHEN NOT gone AND initial = '{initial}' THEN {more(q, 'extra', 'K', 'line')} END"

    def given(q: str, role: str) -> str:
        return f"CASE WHEN NOT gone THEN {more(q, '1 + extra', 'R', f'{chr(39)}{role}:{chr(39)} || text')} END"

    after = [
        more("q0", "2", "D", None),
        f"least({more('q1', '2', 'D', None)}, {kept('q0', 's')})",
        f"least({more('q2', '2', 'D', None)}, {', '.join(f(q, x) for q in ('q0', 'q1', 'q3') for f, x in ((kept, 'u'), (given, 'user')))})",
        f"least({more('q3', '2', 'D', None)}, {kept('q2', 'a')}, {given('q2', 'assistant')})",
    ]
    names = ["q0", "q1", "q2", "q3"]
    rounds = "".join(f", r{k + 1} AS (SELECT conv_id, i, {', '.join(f'{x} AS {q}' for x, q in zip(inserted(names), names, strict=True))} FROM r{k})" for k in range(3))
    return rf"""
WITH RECURSIVE table8 AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) b(i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS code FROM keyed, table8),
broken AS (SELECT row_number() OVER () AS u, conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
           FROM coded, range(2) r(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, u) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, u) AS before,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, u) AS nth FROM broken),
found AS (SELECT *, substr(role, 1, 1) AS initial, role || ':' || text AS line, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
rows_ AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM found),
ids AS (SELECT DISTINCT conv_id FROM conversations),
r0 AS (SELECT conv_id, 0::BIGINT AS i, '000000000' || chr(1) AS q0, NULL::VARCHAR AS q1, NULL::VARCHAR AS q2, NULL::VARCHAR AS q3 FROM ids){rounds},
-- The layers: after each row the rows inserted there.
layers AS (SELECT conv_id, i, q0, q1, q2, q3 FROM r3 UNION ALL
  SELECT conv_id, i, q0, q1, q2, q3 FROM (
    SELECT conv_id, i, {', '.join(f'{x} AS {q}' for x, q in zip(inserted(names), names, strict=True))} FROM (
    SELECT conv_id, i, {', '.join(f'{x} AS {q}' for x, q in zip(inserted(names), names, strict=True))} FROM (
    SELECT conv_id, i, {', '.join(f'{x} AS {q}' for x, q in zip(inserted(names), names, strict=True))} FROM (
    SELECT r.conv_id, r.i, {', '.join(f'{x} AS {q}' for x, q in zip(after, names, strict=True))} FROM layers l JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i + 1))))),
ends AS (SELECT conv_id, arg_max(least(q0, q3), i) AS best FROM layers GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       substr(best, 1, 9)::BIGINT AS cost, substr(best, 10, strpos(best, chr(1)) - 10) AS audit, sha256(substr(best, strpos(best, chr(1)) + 1)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP13_SQL = _sql()
