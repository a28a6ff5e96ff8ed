"""PII: each detected entity gets a keyed surrogate of its type, gender, script and format.

A surrogate depends on the key, the entity's canonical form and an attempt number alone, so one
entity has one surrogate everywhere (coreference). Persons are two entities, a given and a family
name, so everyone of a family shares its surrogate, and a person's full, short and untitled mentions
agree. The distinct entities of the corpus are checked: where two have the same surrogate, or a
surrogate is a real entity, all but the least go to their next attempt (distinctness). Later attempts
of every type draw from a larger space each time, so no corpus runs out of surrogates. Only documents
with entities are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, read, text_or_empty

#: Of the query and the tests, so that their results can be compared. Callers of the operator pass their own secret.
TEST_KEY = "talata-surrogates-1"

_SECRET_HEAD = r"""\b(?i:token|password|passwd|secret|api[_-]?key|access[_-]?key)\b\s{0,3}[=:]\s{0,3}["']?"""
_SECRET = _SECRET_HEAD + r"(?=[_+/\-]*[A-Za-z0-9])[A-Za-z0-9_+/\-]{12,}={0,2}"
# A label never gives characters back, and a domain has at most 127 labels: so no address, however long, goes deep.
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){0,126}\.[A-Za-z]{2,}"
_IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b(?<=\d)"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
_IP6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
_PHONE = r"(?:\+\d{1,3}[ .\-]?|(?<![\d.\-+]))\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<![\d.\-])(?:1[.\-])?\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)"
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
_CARD = r"(?<![\d.\-])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?!\d)"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mister|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra|Dr|Prof|Господин|Госпожа|Κύριος|Κυρία)"
_NAME = r"\p{Lu}[\p{L}'’]*+(?:[-‐]\p{L}[\p{L}'’]*+)*+"
_PERSON = rf"\b{_TITLE}\.?\s(?:\p{{Lu}}\.\s){{0,3}}{_NAME}(?:\s{_NAME})?"

#: Types in the order of the alternatives: where two could start at one place, the first wins.
TYPES = {"secret": _SECRET, "email": _EMAIL, "iban": _IBAN, "ip": _IP, "ip6": _IP6, "ssn": _SSN, "phone": _PHONE, "card": _CARD, "person": _PERSON}
#: One pattern for all; the alternatives begin on few characters, so most of a text is passed over fast.
ENTITY = "|".join(f"(?:{p})" for p in TYPES.values())

#: What a text must contain, one of them, to hold an entity: cheap to look for in every text.
_MARKS = ["@", "=", ":", *_TITLE[3:-1].replace("Señora?", "Señor").split("|")]

# Given names by gender and script, and syllables of other names by script.
GIVEN = {
    "latin-m": ["Adam", "Bruno", "Carlo", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Marco", "Nils", "Oscar", "Paul", "Ruben", "Simon", "Tomas", "Viktor"],
    "latin-f": ["Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera"],
    "cyrillic-m": ["Андрей", "Борис", "Виктор", "Григорий", "Денис", "Иван", "Кирилл", "Леонид", "Максим", "Николай", "Олег", "Павел"],
    "cyrillic-f": ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга"],
    "greek-m": ["Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Μάριος", "Νίκος", "Πέτρος", "Σταύρος"],
    "greek-f": ["Αθηνά", "Βασιλική", "Δέσποινα", "Ελένη", "Ιωάννα", "Μαρία", "Σοφία", "Χριστίνα"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "nu", "pa", "re", "si", "to", "ve", "wi", "zo"],
    "cyrillic": ["ба", "ве", "ги", "до", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фе", "хи", "шо"],
    "greek": ["βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "νυ", "πα", "ρε", "σι", "το", "φε", "χι", "ψο"],
}
#: What ends a given name made of syllables.
ENDINGS = {"latin-m": "n", "latin-f": "na", "cyrillic-m": "н", "cyrillic-f": "на", "greek-m": "ς", "greek-f": "να"}
SYLLABLES_EACH = 4  # of a family name; one more with each attempt
#: Attempts in the usual space of a type: fictional numbers, private addresses, names of the lists, the mention's own length.
USUAL = 3


def _number(key: str, *parts: Column) -> Column:
    """A keyed number from 0 to 2^31 - 1 (SHA-256)."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % (1 << 31)


def _pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (number % len(options)).cast("int") + 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _each(s: Column, f) -> Column:
    return F.array_join(F.transform(F.split(s, ""), f), "")


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Drawn numbers from one digest; each has 16 bits.
DRAWS = 16


def _blocks(count: Column, key: str, parts: tuple[Column, ...], f) -> Column:
    """The strings f(first, size, number) of all blocks of up to DRAWS places, joined; number(j) is the j-th keyed number.

    The entity itself is hashed once, and each block hashes that digest, so the work grows with the
    count and not with its square.
    """
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts], F.lit("stream")), 256)

    def block(seed: Column, b: Column) -> Column:
        drawn = F.sha2(F.concat_ws("\x1f", seed, b.cast("string")), 256)
        return _let(drawn, lambda h: f(b * DRAWS, F.least(count - b * DRAWS, F.lit(DRAWS)), lambda j: F.conv(F.substr(h, j * 4 + 1, F.lit(4)), 16, 10).cast("int")))

    return _let(seed, lambda d: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((count - 1) / DRAWS).cast("int")), lambda b: block(d, b)), ""))


def _drawn(alphabet: str, count: Column, key: str, *parts: Column) -> Column:
    """So many keyed characters of the alphabet; none for 0 or less."""
    count = count.cast("int")

    def some(first: Column, size: Column, number) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.substring(F.lit(alphabet), number(j) % len(alphabet) + 1, 1)), "")

    return F.when(count > 0, _blocks(F.greatest(count, F.lit(1)), key, (*parts, F.lit("drawn")), some)).otherwise("")


_HEX, _SMALL, _TEN = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _is_hex(s: Column) -> Column:
    return s.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$")


def _same_classes(s: Column, key: str, *parts: Column, hexes: Column | None = None) -> Column:
    """Letters for letters of the same case, digits for digits, the rest as it is; hex stays hex."""
    hexes = _is_hex(s) if hexes is None else hexes

    def change(c: Column, n: Column, hexes: Column) -> Column:
        return (
            F.when(hexes & c.rlike("[0-9a-f]"), F.substring(F.lit(_HEX), n % 16 + 1, 1))
            .when(c.rlike("[a-z]"), F.char(97 + n % 26))
            .when(c.rlike("[A-Z]"), F.char(65 + n % 26))
            .when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .otherwise(c)
        )

    def changed(at: Column) -> Column:
        def some(first: Column, size: Column, number) -> Column:
            return F.array_join(F.transform(F.slice(at["cs"], first + 1, size), lambda c, j: change(c, number(j), at["hexes"])), "")

        return _blocks(F.size(at["cs"]), key, (*parts, F.lit("classes")), some)

    return _let(F.struct(F.split(s, "").alias("cs"), hexes.alias("hexes")), changed)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _mod97(s: Column) -> Column:
    """A string of digits and A-Z (A is 10) as a number modulo 97."""

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def may_hold(text: Column) -> Column:
    """False only for texts without any entity."""
    out = text.rlike("[0-9]")
    for mark in _MARKS:
        out = out | text.contains(mark)
    return out


def type_of(entity: Column) -> Column:
    """The type of a whole match, the first alternative that matches all of it; "name" if none does.

    Null for what only looks like an entity: a card number without a Luhn sum, an IBAN with a wrong
    check number, an IPv6 form of fewer than four groups or without a digit.
    """
    digits, plain = _digits(entity), F.replace(entity, F.lit(" "), F.lit(""))
    right = {
        "card": _luhn_sum(digits) % 10 == 0,
        "iban": _mod97(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))) == 1,
        "ip6": entity.rlike("[0-9]") & (F.length(entity) - F.length(F.replace(entity, F.lit(":"), F.lit(""))) >= 3),
    }
    out = F.lit("name")
    for name, pattern in reversed(list(TYPES.items())):
        kind = F.when(right[name], F.lit(name)) if name in right else F.lit(name)
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def person(mention: Column) -> Column:
    """given (null without one), family, and code (script and gender) of a titled mention."""
    name = F.regexp_replace(mention, rf"^{_TITLE}\.?\s", "")
    words = F.split(name, r"\s")
    many = F.size(words) > 1
    given = F.when(many, F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), " "))
    female = mention.rlike(r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία)") | (mention.rlike(r"^(?:Dr|Prof)") & given.rlike("[aаαη]$"))
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    return F.struct(given.alias("given"), F.element_at(words, -1).alias("family"), script.alias("script"), F.concat(script, F.when(female, "-f").otherwise("-m")).alias("code"))


def canonical(kind: Column, entity: Column) -> Column:
    """What makes two mentions one entity: digits, lower case, or the secret itself. National numbers get their 1."""
    digits = _digits(entity)
    size, plus = F.length(digits), entity.startswith("+")
    phone = F.when((size == 10) & ~plus, F.concat(F.lit("1"), digits)).when((size == 11) & digits.startswith("1"), digits).when(plus, F.concat(F.lit("+"), digits)).otherwise(digits)
    return (
        F.when(kind == "phone", phone)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind.isin("email", "ip6"), F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(entity, "^" + _SECRET_HEAD, ""))
        .otherwise(entity)
    )


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate in canonical form. ``more``: how far the attempt is beyond the usual space."""
    own = (kind, canon, attempt)
    n = [_number(key, *own, F.lit(f"part{i}")) for i in range(4)]
    size, more = F.length(canon), F.greatest(attempt - (USUAL - 1), F.lit(0))
    stream = _drawn(_TEN, size + more, key, *own)
    nanp = canon.rlike("^1[0-9]{10}$")
    exchange = F.when(attempt < USUAL, "555").otherwise((200 + n[3] % 800).cast("string"))
    longer = _drawn(_TEN, attempt - 7, key, *own)
    national = F.concat(F.lit("1"), (2 + n[0] % 8).cast("string"), F.lpad((n[1] % 100).cast("string"), 2, "0"), exchange, F.lpad((n[2] % 10000).cast("string"), 4, "0"), longer)
    begun = F.when(canon.startswith("+"), 3).otherwise(1)  # the sign and two digits of the country code, or one digit
    phone = F.when(nanp, national).otherwise(F.concat(F.substr(canon, F.lit(1), begun), F.substr(stream, begun + 1)))
    body = F.concat(F.substring(canon, 1, 1), F.substr(stream, F.lit(2), size - 2), longer)
    card = F.concat(body, F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    full6 = F.concat(F.lit("fd"), F.regexp_replace(_drawn(_HEX, F.lit(30), key, *own), "(?<=^..|^..(?:.{4}){1,6})(?=.)", ":"))
    ip = F.when(attempt >= 8, full6).otherwise(F.concat_ws(".", F.when(attempt < USUAL, "10").otherwise((240 + n[3] % 15).cast("string")), *[(1 + x % 254).cast("string") for x in n[:3]]))
    ip6 = F.when(attempt >= USUAL, full6).otherwise(_same_classes(canon, key, *own, hexes=F.lit(True)))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    tail = F.substring_index(domain, ".", -1)
    head = F.substr(domain, F.lit(1), F.length(domain) - F.length(tail))
    email = F.concat(_same_classes(local, key, *own), _drawn(_SMALL, more, key, *own), F.lit("@"), _same_classes(head, key, F.lit("domain"), domain), tail)
    bank = F.concat(_same_classes(F.substr(canon, F.lit(5)), key, *own, hexes=F.lit(False)), longer)
    check = F.lpad((98 - _mod97(F.concat(bank, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(F.substring(canon, 1, 2), check, bank)
    extra = F.when(_is_hex(canon), _drawn(_HEX, more, key, *own)).otherwise(_drawn(_SMALL, more, key, *own))
    code = F.substring_index(canon, ":", 1)
    script = F.substring_index(code, "-", 1)

    def spelled(count: Column) -> Column:
        """A name of so many syllables in the script of the mention."""

        def of(syllables: list[str]) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: _pick(syllables, _number(key, *own, i))), "")

        return F.when(script == "cyrillic", of(SYLLABLES["cyrillic"])).when(script == "greek", of(SYLLABLES["greek"])).otherwise(of(SYLLABLES["latin"]))

    listed, ending = F.lit(""), F.lit("")
    for option, names in GIVEN.items():
        second = F.when(attempt > 0, F.concat(F.lit("-"), _pick(names, n[1]))).otherwise("")
        listed = F.when(code == option, F.concat(_pick(names, n[0]), second)).otherwise(listed)
        ending = F.when(code == option, ENDINGS[option]).otherwise(ending)
    initials = F.regexp_replace(_drawn(_SMALL.upper(), 1 + (attempt / USUAL).cast("int"), key, *own), "(?<=.)(?=.)", ". ")
    given = F.when(canon.endswith("."), F.concat(initials, F.lit("."))).when(attempt < USUAL, listed).otherwise(F.initcap(F.concat(spelled(attempt), ending)))
    return (
        F.when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(stream, F.lit(2), F.lit(8)), longer))
        .when(kind == "ip", ip)
        .when(kind == "ip6", ip6)
        .when(kind == "email", email)
        .when(kind == "iban", iban)
        .when(kind == "family", F.initcap(spelled(SYLLABLES_EACH + attempt)))
        .when(kind == "given", given)
        .otherwise(F.concat(_same_classes(canon, key, *own), extra))
    )


def written(kind: Column, entity: Column, made: Column, given: Column) -> Column:
    """The surrogate in the format of the mention: its separators, its case, its title or key word.

    What a surrogate has more than the mention has places for stands at the end.
    """
    plain = r"[^0-9A-Za-z]"
    national = (kind == "phone") & made.startswith("1") & (F.length(_digits(entity)) == 10) & ~entity.startswith("+")
    put = F.when(national, F.substr(made, F.lit(2))).when(kind == "phone", _digits(made)).otherwise(made)
    places = F.length(F.regexp_replace(entity, plain, ""))
    spread = _each(entity, lambda c, i: F.when(c.rlike(plain), c).otherwise(F.substr(put, F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), plain, "")), F.lit(1))))
    head = F.regexp_extract(entity, "^" + _SECRET_HEAD, 0)
    title = F.regexp_extract(entity, rf"^{_TITLE}\.?\s", 0)
    name = F.substr(entity, F.length(title) + 1)
    loud = (name == F.upper(name)) & (F.length(name) > 2)
    said = F.concat(F.coalesce(F.concat(given, F.lit(" ")), F.lit("")), made)
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), F.concat(spread, F.substr(put, places + 1)))
        .when(kind == "secret", F.concat(head, made))
        .when(kind.isin("person", "name"), F.concat(title, F.when(loud, F.upper(said)).otherwise(said)))
        .when(kind.isin("email", "ip6") & (entity == F.upper(entity)), F.upper(made))
        .otherwise(made)
    )


def _space(kind: Column) -> Column:
    """Given and family names share one space, and no surrogate of it is a real name of either kind."""
    return F.when(kind.isin("given", "family"), "name").otherwise(kind)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Distinct ``entities`` (kind, canon) -> (kind, canon, made) without clashes.

    Of entities that clash the least keeps its surrogate; no surrogate is an entity of its type.
    The others try again until none is left: each attempt beyond the usual ones has a larger space.
    """
    real = F.lower(F.when(F.col("kind").isin("given", "family"), F.substring_index("canon", ":", -1)).otherwise(F.col("canon")))
    taken = entities.select(_space(F.col("kind")).alias("space"), real.alias("form"))
    pending, settled, attempt = entities.select("kind", "canon"), None, 0
    while True:
        tried = pending.select("kind", "canon", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key).alias("made"))
        tried = materialize(tried.select("*", _space(F.col("kind")).alias("space"), F.lower("made").alias("form")), "surrogates")
        free = tried.join(taken.distinct(), ["space", "form"], "left_anti")
        won = free.groupBy("space", "form").agg(F.min(F.struct("kind", "canon", "made")).alias("one"))
        won = materialize(won.select("one.*", "space", "form"), "assigned")
        settled = won if settled is None else settled.unionAll(won)
        before, pending = pending if attempt else None, materialize(tried.join(won, ["kind", "canon"], "left_anti").select("kind", "canon"), "clashes")
        drop_table(tried)
        drop_table(before)
        if pending.isEmpty():
            return settled.select("kind", "canon", "made")
        taken = taken.unionAll(won.select("space", "form"))
        attempt += 1


def _mentions(hits: DataFrame) -> DataFrame:
    """``hits`` (id, found, people) -> id, at, entity, kind, and up to two entities: (k1, c1) and a given name c2."""
    rows = hits.select("id", "people", F.posexplode("found").alias("at", "entity"))
    rows = rows.select("id", "at", "entity", "people", type_of(F.col("entity")).alias("kind"))
    entity, kind = F.col("entity"), F.col("kind")

    def known(test) -> Column:
        return F.get(F.filter("people", test), F.lit(0))

    said, none = F.lower(entity), F.lit(None).cast("string")
    full = known(lambda p: F.lower(F.concat(p["given"], F.lit(" "), p["family"])) == said)
    bare = F.coalesce(full, known(lambda p: F.lower(p["family"]) == said).withField("given", none), known(lambda p: F.lower(p["given"]) == said).withField("family", none))
    rows = rows.withColumn("who", F.when(kind == "person", person(entity)).when(kind == "name", bare)).drop("people")
    given = F.concat(F.col("who.code"), F.lit(":"), F.col("who.given"))
    family = F.concat(F.col("who.script"), F.lit(":"), F.lower("who.family"))
    named = F.col("who").isNotNull()
    return rows.select(
        "id", "at", "entity", "kind",
        F.when(named, F.when(family.isNotNull(), "family").otherwise("given")).otherwise(kind).alias("k1"),
        F.when(named, F.coalesce(family, given)).otherwise(canonical(kind, entity)).alias("c1"),
        F.when(named & family.isNotNull(), given).alias("c2"),
    )


def replace_entities(docs: DataFrame, key: str, *, details: bool = False) -> DataFrame:
    """``docs`` with every detected entity of ``text`` replaced; all other columns and rows stay.

    ``key`` is the caller's secret: with another key, all surrogates differ. A person mentioned with
    a title is also found without it in the same text, by full, family or given name as it is
    written there or in capitals. Null texts
    stay null and empty ones empty; very long texts are whole; of ties the least entity keeps its
    surrogate. Repeated rows get the same replacements. With ``details``, n_entities (int) and kinds
    (comma-joined, sorted) are added. An empty table gives no rows. Other columns may have any name.
    """
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")
    holds = may_hold(text_or_empty()) & text_or_empty().rlike(ENTITY)
    clean = docs.where(~holds).select(row)
    titled = F.filter(F.regexp_extract_all(text_or_empty(), F.lit(ENTITY), F.lit(0)), lambda e: e.rlike(f"^(?:{_PERSON})$"))
    hits = docs.where(holds).select(row, F.array_distinct(F.transform(F.array_distinct(titled), person)).alias("people"))
    full = F.transform(F.filter("people", lambda p: p["given"].isNotNull()), lambda p: F.concat(p["given"], F.lit(" "), p["family"]))
    short = F.concat(F.transform("people", lambda p: p["family"]), F.transform(F.filter("people", lambda p: p["given"].isNotNull() & ~p["given"].contains(".")), lambda p: p["given"]))
    names = F.concat(full, short)
    quoted = F.array_join(F.transform(F.array_distinct(F.concat(names, F.transform(names, F.upper))), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|")
    pattern = F.when(F.size("people") == 0, F.lit(ENTITY)).otherwise(F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])")))
    hits = hits.select(F.monotonically_increasing_id().alias("id"), "doc", "people", pattern.alias("pattern"))
    hits = materialize(hits.select("id", "doc", "people", "pattern", F.regexp_extract_all("doc.text", F.col("pattern"), F.lit(0)).alias("found")), "entity-docs")
    mentions = materialize(_mentions(hits), "mentions")
    real = mentions.where("kind IS NOT NULL")
    made = assign(real.select(F.col("k1").alias("kind"), F.col("c1").alias("canon")).unionAll(real.where("c2 IS NOT NULL").select(F.lit("given"), "c2")).distinct(), key)
    put = real.join(made.toDF("k1", "c1", "made"), ["k1", "c1"])
    first = made.where("kind = 'given'").select(F.col("canon").alias("c2"), F.col("made").alias("given"))
    put = put.where("c2 IS NULL").withColumn("given", F.lit(None).cast("string")).unionByName(put.where("c2 IS NOT NULL").join(first, "c2"))
    put = put.select("id", "at", F.when(F.col("kind") == "name", "person").otherwise(F.col("kind")).alias("kind"), written(F.col("kind"), F.col("entity"), F.col("made"), F.col("given")).alias("put"))
    same = mentions.where("kind IS NULL").select("id", "at", F.lit(None).cast("string").alias("kind"), F.col("entity").alias("put"))
    by_doc = put.unionAll(same).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "put"))).alias("puts"), F.count("kind").cast("int").alias("n_entities"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    pieces = F.zip_with(F.split("doc.text", F.col("pattern"), -1), "puts.put", lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    changed = hits.join(by_doc, "id").select(F.col("doc").withField("text", F.array_join(pieces, "")).alias("doc"), "n_entities", "kinds")
    both = changed.unionByName(clean.select("doc", F.lit(0).alias("n_entities"), F.lit("").alias("kinds")))
    return both.select(*[F.col("doc").getField(c).alias(c) for c in columns], *(["n_entities", "kinds"] if details else []))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY, details=True)
