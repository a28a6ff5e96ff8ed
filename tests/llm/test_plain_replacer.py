"""The surrogates of whole documents against a plain replacer: the same rules with loops and one dictionary."""

import hashlib
import math

import regex
from pyspark.sql import functions as F

from talata.llm import surrogates as S

KEY = "a test's key"


def own(pattern):
    """The pattern as Java reads it: digits and white space are ASCII."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\d", r"\s", r"\D"):
            ascii_ = {r"\d": "0-9", r"\s": r" \t\n\x0b\f\r", r"\D": "^0-9"}[two]
            out += ascii_ if inside else f"[{ascii_}]"
            i += 2
        elif two[0] == "\\":
            out += two
            i += 2
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out += pattern[i]
            i += 1
    return regex.compile(out)


ENTITY, TYPES = own(S.ENTITY), {name: own(f"^(?:{p})$") for name, p in S.TYPES.items()}
TITLE, HEAD = own(rf"^{S._TITLE}\.?\s"), own("^" + S._SECRET_HEAD)


def sha(*parts):
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


def number(*parts):
    return int(sha(KEY, *parts)[:8], 16) % (1 << 31)


def numbers(n, *parts):
    seed = sha(KEY, *parts, "stream")
    return [int(sha(seed, b)[4 * j : 4 * j + 4], 16) for b in range(math.ceil(n / S.DRAWS)) for j in range(S.DRAWS)][:n]


def drawn(alphabet, n, *parts):
    return "".join(alphabet[x % len(alphabet)] for x in numbers(n, *parts, "drawn")) if n > 0 else ""


def is_hex(s):
    return bool(regex.fullmatch("[0-9a-f]+", s)) and any(c.isdigit() for c in s) and any(c in "abcdef" for c in s)


def same_classes(s, *parts, hexes=None):
    hexes, out = is_hex(s) if hexes is None else hexes, ""
    for c, n in zip(s, numbers(len(s), *parts, "classes"), strict=True):
        if hexes and c in S._HEX:
            out += S._HEX[n % 16]
        elif "a" <= c <= "z" or "A" <= c <= "Z":
            out += chr((97 if c.islower() else 65) + n % 26)
        else:
            out += str(n % 10) if "0" <= c <= "9" else c
    return out


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 % 10 + int(d) // 5 for i, d in enumerate(reversed(digits)))


def mod97(s):
    return int("".join(c if c.isdigit() else str(ord(c) - 55) for c in s)) % 97


def digits(s):
    return regex.sub("[^0-9]", "", s)


def type_of(entity):
    for name, pattern in TYPES.items():
        if pattern.match(entity):
            plain = entity.replace(" ", "")
            right = {"card": lambda: luhn(digits(entity)) % 10 == 0, "iban": lambda: mod97(plain[4:] + plain[:4]) == 1, "ip6": lambda: any(c.isdigit() for c in entity) and entity.count(":") >= 3}
            return name if right.get(name, lambda: True)() else None
    return "name"


def person(mention):
    words = regex.split(r"[ \t\n\x0b\f\r]", TITLE.sub("", mention))
    name, given = " ".join(words), " ".join(words[:-1]) if len(words) > 1 else None
    female = regex.match("Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία", mention) or (regex.match("Dr|Prof", mention) and given and given[-1] in "aаαη")
    script = "cyrillic" if regex.search(r"\p{IsCyrillic}", name) else "greek" if regex.search(r"\p{IsGreek}", name) else "latin"
    return given, words[-1], script, script + ("-f" if female else "-m")


def canonical(kind, entity):
    d = digits(entity)
    if kind == "phone":
        plus = entity.startswith("+")
        return "1" + d if len(d) == 10 and not plus else d if len(d) == 11 and d[0] == "1" else "+" + d if plus else d
    return {"card": d, "ssn": d, "email": entity.lower(), "ip6": entity.lower(), "iban": entity.replace(" ", ""), "secret": HEAD.sub("", entity)}.get(kind, entity)


def surrogate(kind, canon, attempt):
    p = (kind, canon, attempt)
    n = [number(*p, f"part{i}") for i in range(4)]
    size, more, usual = len(canon), max(0, attempt - (S.USUAL - 1)), attempt < S.USUAL
    stream, longer = drawn(S._TEN, size + more, *p), drawn(S._TEN, attempt - 7, *p)
    script, code = canon.partition(":")[0].partition("-")[0], canon.partition(":")[0]
    if kind == "phone":
        if regex.fullmatch("1[0-9]{10}", canon):
            return f"1{2 + n[0] % 8}{n[1] % 100:02}{'555' if usual else 200 + n[3] % 800}{n[2] % 10000:04}{longer}"
        begun = 3 if canon[0] == "+" else 1
        return canon[:begun] + stream[begun:]
    if kind == "card":
        body = canon[0] + stream[1 : size - 1] + longer
        return body + str(-luhn(body + "0") % 10)
    if kind == "ssn":
        return "9" + stream[1:9] + longer
    full6 = ":".join(["fd" + drawn(S._HEX, 30, *p)[:2], *[drawn(S._HEX, 30, *p)[i : i + 4] for i in range(2, 30, 4)]])
    if kind == "ip":
        return full6 if attempt >= 8 else ".".join(["10" if usual else str(240 + n[3] % 15), *[str(1 + x % 254) for x in n[:3]]])
    if kind == "ip6":
        return full6 if attempt >= S.USUAL else same_classes(canon, *p, hexes=True)
    if kind == "email":
        local, domain = canon.split("@", 1)[0], canon.rsplit("@", 1)[1]
        tail = domain.rsplit(".", 1)[1]
        return same_classes(local, *p) + drawn(S._SMALL, more, *p) + "@" + same_classes(domain[: -len(tail)], "domain", domain) + tail
    if kind == "iban":
        bank = same_classes(canon[4:], *p, hexes=False) + longer
        return canon[:2] + f"{98 - mod97(bank + canon[:2] + '00'):02}" + bank
    spelled = lambda count: "".join(S.SYLLABLES[script][number(*p, i) % len(S.SYLLABLES[script])] for i in range(1, count + 1))
    title = lambda s: s[:1].upper() + s[1:].lower()
    if kind == "family":
        return title(spelled(S.SYLLABLES_EACH + attempt))
    if kind == "given":
        if canon.endswith("."):
            return ". ".join(drawn(S._SMALL.upper(), 1 + attempt // S.USUAL, *p)) + "."
        names = S.GIVEN[code]
        listed = names[n[0] % len(names)] + (f"-{names[n[1] % len(names)]}" if attempt else "")
        return listed if usual else title(spelled(attempt) + S.ENDINGS[code])
    return same_classes(canon, *p) + drawn(S._HEX if is_hex(canon) else S._SMALL, more, *p)


def space(kind):
    return "name" if kind in ("given", "family") else kind


def assign(entities):
    real = {(space(k), (c.rsplit(":", 1)[1] if k in ("given", "family") else c).lower()) for k, c in entities}
    taken, made, pending, attempt = set(real), {}, set(entities), 0
    while pending:
        tried = {e: surrogate(*e, attempt) for e in pending}
        won = {}
        for e in sorted(tried, key=lambda e: (e[0].encode(), e[1].encode())):
            form = (space(e[0]), tried[e].lower())
            if form not in taken and form not in won:
                won[form] = e
        made |= {e: tried[e] for e in won.values()}
        taken |= set(won)
        pending -= set(won.values())
        attempt += 1
    return made


def written(kind, entity, made, given):
    if kind in ("phone", "card", "ssn", "iban"):
        d = digits(entity)
        national = kind == "phone" and made.startswith("1") and len(d) == 10 and not entity.startswith("+")
        put = made[1:] if national else digits(made) if kind == "phone" else made
        out, i = "", 0
        for c in entity:
            if regex.match("[0-9A-Za-z]", c):
                out += put[i : i + 1]
                i += 1
            else:
                out += c
        return out + put[i:]
    if kind == "secret":
        return HEAD.match(entity)[0] + made
    if kind in ("person", "name"):
        head = m[0] if (m := TITLE.match(entity)) else ""
        name, said = entity[len(head) :], (f"{given} " if given is not None else "") + made
        return head + (said.upper() if name == name.upper() and len(name) > 2 else said)
    return made.upper() if kind in ("email", "ip6") and entity == entity.upper() else made


def replace_all(texts):
    found, entities = [], set()
    for text in texts:
        people = list(dict.fromkeys(person(e) for e in ENTITY.findall(text) if TYPES["person"].match(e)))
        full = [f"{g} {f}" for g, f, _, _ in people if g is not None]
        names = [*full, *[f for _, f, _, _ in people], *[g for g, _, _, _ in people if g is not None and "." not in g]]
        pattern = ENTITY
        if people:
            said = "|".join(map(regex.escape, dict.fromkeys([*names, *[x.upper() for x in names]])))
            pattern = regex.compile(ENTITY.pattern + r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?:" + said + r")(?![\p{L}\p{N}])")
        spots = []
        for m in pattern.finditer(text):
            entity, kind = m[0], type_of(m[0])
            keys = None
            if kind in ("person", "name"):
                if kind == "person":
                    who = person(entity)
                else:
                    low = entity.lower()
                    of = lambda f: next((x for x in people if (v := f(x)) is not None and v.lower() == low), None)
                    if (w := of(lambda x: f"{x[0]} {x[1]}" if x[0] is not None else None)) is not None:
                        who = w
                    elif (w := of(lambda x: x[1])) is not None:
                        who = (None, *w[1:])
                    else:
                        w = of(lambda x: x[0])
                        who = (w[0], None, *w[2:])
                given, family, script, code = who
                g = None if given is None else ("given", f"{code}:{given}")
                keys = (("family", f"{script}:{family.lower()}"), g) if family is not None else (g, None)
            elif kind is not None:
                keys = ((kind, canonical(kind, entity)), None)
            if keys:
                entities.update(k for k in keys if k)
            spots.append((m.start(), m.end(), kind, entity, keys))
        found.append(spots)
    made, out = assign(entities), []
    for text, spots in zip(texts, found, strict=True):
        new, at = "", 0
        for a, b, kind, entity, keys in spots:
            new += text[at:a] + (entity if keys is None else written(kind, entity, made[keys[0]], made[keys[1]] if keys[1] else None))
            at = b
        out.append(new + text[at:])
    return out


def test_documents_equal_the_plain_replacer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where(F.col("text").isNotNull())
    extra = ["Mr. Ann Lee met ANN LEE. Lee said hi; Ann too.", "Господин Иван Петров и Петров", "Dr Anna B. Ott, prof. Ott", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "GB82 WEST 1234 5698 7654 32", "fe80::1:2:3 and 2001:db8:0:0:0:0:0:1", "token=abcdef0123456789abcdef A@B.CO a@b.co"]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1 - i, t) for i, t in enumerate(extra)]
    made = {r.doc_id: r.text for r in S.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    plain = dict(zip([i for i, _ in rows], replace_all([t for _, t in rows]), strict=True))
    assert len(made) == len(rows) >= 500
    changed = [i for i, t in rows if made[i] != t]
    assert len(changed) > 40
    assert {i: made[i] for i, _ in rows if made[i] != plain[i]} == {}
