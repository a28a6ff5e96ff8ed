"""License scans by ordered signature rules.

Each rule is a regular expression over the lower-cased text with a label, a priority, a confidence
and keywords. An automaton finds which keywords a text has; only rules with one of them run. Where
detections overlap, an interval inside another of the same or higher priority is suppressed, and of
equal intervals the rule that comes first stays. The base phrases are found apart, on words, and
their labels always stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .signatures import SIGNATURES

#: Base phrases and labels. Fixed values of the contract.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_V = r"[\s,]{0,3}(?:version|ver\.?|v\.?)?\s{0,2}"  # "version" before a number
_GAP = r"[\s,(]{1,4}"
_OR_LATER = r"[\s,(]{0,4}(?:or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?(?:later|newer|above)|\+)"
_CC_WORDS = r"creative\s+commons\s+attribution"

# (label, SPDX identifier, names, grant or body wording, addresses): each is a regular expression,
# "" where there is none. Versions and the ways to cite a license are added by the rules below.
LICENSES = [
    ("agpl-3.0", "agpl-3\\.0(?:-only)?", rf"(?:gnu\s+affero\s+general\s+public\s+licen[cs]e|\bagpl){_V}3(?:\.0)?\b", r"remote\s+network\s+interaction;?\s+use\s+with\s+the\s+gnu\s+general", r"gnu\.org/licenses/agpl"),
    ("agpl-1.0", "agpl-1\\.0(?:-only)?", rf"affero\s+general\s+public\s+licen[cs]e{_V}1\b", "", r"affero\.org/oagpl"),
    ("gpl-1.0", "gpl-1\\.0(?:-only)?", rf"(?:gnu\s+general\s+public\s+licen[cs]e|\bgnu\s+gpl|\bgpl){_V}1(?:\.0)?\b", "", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "gpl-2\\.0(?:-only)?", rf"(?:gnu\s+general\s+public\s+licen[cs]e|\bgnu\s+gpl|\bgpl){_V}2(?:\.0)?\b", r"either\s+version\s+2\s+of\s+the\s+license", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gpl-3\\.0(?:-only)?", rf"(?:gnu\s+general\s+public\s+licen[cs]e|\bgnu\s+gpl|\bgpl){_V}3(?:\.0)?\b", r"either\s+version\s+3\s+of\s+the\s+license", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.0", "lgpl-2\\.0(?:-only)?", rf"(?:gnu\s+library\s+general\s+public\s+licen[cs]e|\blgpl){_V}2(?:\.0)?(?![.\d])", "", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "lgpl-2\\.1(?:-only)?", rf"(?:gnu\s+lesser\s+general\s+public\s+licen[cs]e|\blgpl){_V}2\.1\b", r"either\s+version\s+2\.1\s+of\s+the\s+license", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lgpl-3\\.0(?:-only)?", rf"(?:gnu\s+lesser\s+general\s+public\s+licen[cs]e|\blgpl){_V}3(?:\.0)?\b", "", r"gnu\.org/licenses/lgpl-3\.0"),
    ("gfdl", "gfdl-1\\.[123](?:-only|-or-later)?", r"gnu\s+free\s+documentation\s+licen[cs]e", r"no\s+invariant\s+sections,\s+no\s+front-cover\s+texts", r"gnu\.org/licenses/fdl"),
    ("apache-1.0", "apache-1\\.0", rf"apache\s+(?:software\s+)?licen[cs]e{_V}1\.0\b", "", r"apache\.org/licenses/license-1\.0"),
    ("apache-1.1", "apache-1\\.1", rf"apache\s+(?:software\s+)?licen[cs]e{_V}1\.1\b", "", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache-2\\.0", rf"(?:apache\s+(?:software\s+)?licen[cs]e|\bapache|\basl){_V}2(?:\.0)?\b", r"distributed\s+on\s+an\s+\"as\s+is\"\s+basis,\s+without\s+warranties\s+or\s+conditions", r"apache\.org/licenses/license-2\.0"),
    ("mit", "mit", r"\b(?:mit|expat)(?:\s*/\s*x11|-style|-type)?\s+licen[cs]ed?\b", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy", r"opensource\.org/licenses?/mit(?:-license)?"),
    ("mit-0", "mit-0", r"\bmit\s+no\s+attribution\b", "", r"opensource\.org/licenses?/mit-0"),
    ("x11", "x11", r"\bx11\s+licen[cs]e|\bx\s+consortium\s+licen[cs]e", r"except\s+as\s+contained\s+in\s+this\s+notice,\s+the\s+name\s+of\s+the\s+x\s+consortium", ""),
    ("0bsd", "0bsd", r"\b(?:zero-clause|0-clause|free\s+public)\s+(?:bsd\s+)?licen[cs]e", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and/or\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted\.", r"opensource\.org/licenses?/0bsd"),
    ("bsd-2-clause", "bsd-2-clause", r"\b(?:2-clause|two-clause|simplified|freebsd)\s+(?:bsd\s+)?licen[cs]e|\bbsd[-\s]2(?:[-\s]clause)?\b", "", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd-3-clause", r"\b(?:3-clause|three-clause|modified|new|revised)\s+bsd\s+licen[cs]e|\bbsd[-\s]3(?:[-\s]clause)?\b", r"neither\s+the\s+names?\s+of\s+.{1,120}?\s+nor\s+the\s+names\s+of\s+(?:its|their|other)\s+contributors", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd-4-clause", r"\b(?:4-clause|four-clause|original|old)\s+bsd\s+licen[cs]e|\bbsd[-\s]4(?:[-\s]clause)?\b", r"all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software", ""),
    ("bsd", "bsd", r"\bbsd(?:-style|-type|-like)?\s+licen[cs]e", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification", r"opensource\.org/licenses?/bsd-license"),
    ("isc", "isc", r"\b(?:isc|internet\s+systems\s+consortium)\s+licen[cs]e", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose", r"opensource\.org/licenses?/isc"),
    ("mpl-1.0", "mpl-1\\.0", rf"(?:mozilla\s+public\s+licen[cs]e|\bmpl){_V}1\.0\b", "", r"mozilla\.org/mpl/1\.0"),
    ("mpl-1.1", "mpl-1\\.1", rf"(?:mozilla\s+public\s+licen[cs]e|\bmpl){_V}1\.1\b", "", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("mpl-2.0", "mpl-2\\.0", rf"(?:mozilla\s+public\s+licen[cs]e|\bmpl){_V}2(?:\.0)?\b", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "epl-1\\.0", rf"(?:eclipse\s+public\s+licen[cs]e|\bepl){_V}1(?:\.0)?\b", "", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "epl-2\\.0", rf"(?:eclipse\s+public\s+licen[cs]e|\bepl){_V}2(?:\.0)?\b", "", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cpl-1.0", "cpl-1\\.0", r"\bcommon\s+public\s+licen[cs]e\b", "", r"opensource\.org/licenses?/cpl"),
    ("cddl-1.0", "cddl-1\\.[01]", r"\bcommon\s+development\s+and\s+distribution\s+licen[cs]e|\bcddl\b", "", r"opensource\.org/licenses?/cddl"),
    ("eupl-1.2", "eupl-1\\.[012]", r"\beuropean\s+union\s+public\s+licen[cs]e|\beupl\b", "", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    ("artistic-1.0", "artistic-1\\.0(?:-perl|-cl8)?", rf"\bartistic\s+licen[cs]e{_V}1(?:\.0)?\b", "", r"opensource\.org/licenses?/artistic-license-1"),
    ("artistic-2.0", "artistic-2\\.0", rf"\bartistic\s+licen[cs]e{_V}2(?:\.0)?\b", "", r"opensource\.org/licenses?/artistic-license-2"),
    ("perl", "", r"\bsame\s+terms\s+as\s+perl\b", "", r"dev\.perl\.org/licenses"),
    ("bsl-1.0", "bsl-1\\.0", r"\bboost\s+software\s+licen[cs]e", "", r"boost\.org/license_1_0"),
    ("busl-1.1", "busl-1\\.1", r"\bbusiness\s+source\s+licen[cs]e", "", r"mariadb\.com/bsl11"),
    ("sspl-1.0", "sspl-1\\.0", r"\bserver\s+side\s+public\s+licen[cs]e|\bsspl\b", "", r"mongodb\.com/licensing/server-side"),
    ("elastic-2.0", "elastic-2\\.0", r"\belastic\s+licen[cs]e", "", r"elastic\.co/licensing/elastic-license"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)?\s+licen[cs]e", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such", r"opensource\.org/licenses?/zlib"),
    ("libpng", "libpng(?:-2\\.0)?", r"\blibpng\s+licen[cs]e", "", r"libpng\.org/pub/png/src/libpng-license"),
    ("unlicense", "unlicense", r"\bthe\s+unlicen[cs]e\b|\bunlicense\s+licen[cs]e", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"\bdo\s+what\s+the\s+f\w{1,4}\s+you\s+want\s+to\s+public\s+licen[cs]e|\bwtfpl\b", "", r"wtfpl\.net"),
    ("cc0-1.0", "cc0-1\\.0", r"\bcc0\b|\bcc\s+zero\b|\bcreative\s+commons\s+zero\b", "", r"creativecommons\.org/publicdomain/zero"),
    ("python-2.0", "(?:python|psf)-2\\.0", r"\b(?:python\s+software\s+foundation|psf)\s+licen[cs]e|\bpsfl\b", "", r"python\.org/(?:psf/)?license"),
    ("php-3.0", "php-3\\.01?", r"\bphp\s+licen[cs]e", "", r"php\.net/license"),
    ("ruby", "ruby", r"\b(?:same\s+terms\s+as\s+ruby|ruby(?:'s)?\s+licen[cs]e)\b", "", r"ruby-lang\.org/.{0,20}license"),
    ("ofl-1.1", "ofl-1\\.[01]", r"\b(?:sil\s+)?open\s+font\s+licen[cs]e", "", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "odbl-1\\.0", r"\bopen\s+(?:data\s*)?base\s+licen[cs]e|\bodbl\b", "", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "odc-by-1\\.0", r"\bopen\s+data\s+commons\s+attribution", "", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "pddl-1\\.0", r"\bpublic\s+domain\s+dedication\s+and\s+licen[cs]e|\bpddl\b", "", r"opendatacommons\.org/licenses/pddl"),
    ("afl-3.0", "afl-[123]\\.\\d", r"\bacademic\s+free\s+licen[cs]e", "", r"opensource\.org/licenses?/afl"),
    ("osl-3.0", "osl-[123]\\.\\d", r"\bopen\s+software\s+licen[cs]e", "", r"opensource\.org/licenses?/osl"),
    ("ms-pl", "ms-pl", r"\bmicrosoft\s+public\s+licen[cs]e|\bms-pl\b", "", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "ms-rl", r"\bmicrosoft\s+reciprocal\s+licen[cs]e|\bms-rl\b", "", r"opensource\.org/licenses?/ms-rl"),
    ("ncsa", "ncsa", r"\b(?:university\s+of\s+illinois/?\s*)?ncsa\s+(?:open\s+source\s+)?licen[cs]e", "", r"opensource\.org/licenses?/ncsa|opensource\.org/licenses?/uoi-ncsa"),
    ("openssl", "openssl", r"\bopenssl\s+licen[cs]e", r"includes\s+software\s+developed\s+by\s+the\s+openssl\s+project", r"openssl\.org/source/license"),
    ("postgresql", "postgresql", r"\bpostgresql\s+licen[cs]e", "", r"postgresql\.org/about/licen[cs]e"),
    ("qpl-1.0", "qpl-1\\.0", r"\bq\s+public\s+licen[cs]e", "", r"opensource\.org/licenses?/qtpl"),
    ("vim", "vim", r"\bvim\s+licen[cs]e", "", ""),
    ("upl-1.0", "upl-1\\.0", r"\buniversal\s+permissive\s+licen[cs]e", "", r"opensource\.org/licenses?/upl"),
    ("mulan-psl-2.0", "mulanpsl-2\\.0", r"\bmulan\s+(?:permissive\s+software\s+licen[cs]e|psl)", "", r"license\.coscl\.org\.cn/mulanpsl"),
    ("cecill-2.1", "cecill-[12]\\.\\d|cecill-[bc]", r"\bcecill\b", "", r"cecill\.info"),
    ("llama", "", r"\bllama\s+[234](?:\.\d)?\s+community\s+licen[cs]e", "", r"llama\.meta\.com/.{0,12}license"),
    ("openrail", "", r"\b(?:creativeml\s+)?open\s*rail(?:-?m|\+\+-m)?\b", "", r"huggingface\.co/.{0,40}license"),
    ("proprietary", "", r"\ball\s+rights\s+reserved\b", r"\bno\s+part\s+of\s+this\s+(?:publication|work|book|document)\s+may\s+be\s+reproduced", ""),
    ("public-domain", "", r"\b(?:released|placed|dedicated|is)\s+(?:in|into|to)\s+the\s+public\s+domain\b", "", r"creativecommons\.org/publicdomain/mark"),
]

#: Creative Commons elements after BY; versions are read from the text.
CC_PARTS = ["", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd"]
_CC_NAMES = {"sa": r"share\s?-?alike", "nc": r"non\s?-?commercial", "nd": r"no\s?-?deriv(?:ative)?s?(?:\s+works)?"}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int  # higher wins
    confidence: float
    keywords: tuple[str, ...]


def _needed(parsed) -> tuple[str, ...]:
    """Literals one of which every match has, from a parsed pattern; () if there are none.

    Of what a sequence offers, the set whose shortest literal is longest is taken.
    """
    offers: list[tuple[str, ...]] = []
    run = ""
    for op, value in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        if run:
            offers.append((run,))
            run = ""
        if name == "SUBPATTERN":
            offers.append(_needed(value[-1]))
        elif name == "BRANCH":
            branches = [_needed(x) for x in value[1]]
            offers.append(tuple(k for x in branches for k in x) if all(branches) else ())
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            offers.append(_needed(value[2]))
    return max(offers, key=lambda o: min(map(len, o), default=0), default=())


def _keywords(pattern: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(_needed(re._parser.parse(pattern))))


def build_rules() -> list[Rule]:
    """All rules in order. A rule without keywords of its own would run on every text; none is."""
    rules: list[Rule] = []

    def add(label: str, pattern: str, priority: int, confidence: float) -> None:
        rules.append(Rule(label, pattern, priority, confidence, _keywords(pattern)))

    for label, spdx, name, body, url in LICENSES:
        family = re.match(r"[al]?gpl", label)
        if family and label.startswith(("gpl", "lgpl", "agpl")):
            later = f"{label}-or-later"
            add(later, rf"spdx-license-identifier:\s{{0,4}}(?:{spdx.replace('(?:-only)?', '')})(?:-or-later|\+)", 95, 1.0)
            add(later, rf"(?:{name}){_OR_LATER}", 85, 0.95)
        if spdx:
            add(label, rf"spdx-license-identifier:\s{{0,4}}(?:{spdx})(?![\w+-])", 90, 1.0)
        if url:
            add(label, rf"(?:{url})", 70, 0.9)
        add(label, rf"(?:licensed|released|distributed|published|available|provided)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:{name})", 80, 0.95)
        add(label, rf"(?:{name})", 60, 0.8)
        if body:
            add(label, rf"(?:{body})", 75, 0.9)
    for parts in CC_PARTS:
        short = r"\bcc[\s-]by" + parts.replace("-", r"[\s-]") + r"(?![\s-](?:nc|nd|sa))"
        long = _CC_WORDS + "".join(rf"[\s,-]{{1,3}}(?:and\s+)?{_CC_NAMES[p]}" for p in parts.strip("-").split("-") if p) + r"(?![\s,-]{1,3}(?:share|non|no\s?-?deriv))"
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v = version.replace(".", r"\.")
            add(f"cc-by{parts}-{version}", rf"{short}[\s-]{_V}{v}", 78, 0.95)
            add(f"cc-by{parts}-{version}", rf"{long}\s+{v}|{long}\s+[\w\s.-]{{0,30}}?{v}\s+(?:international|unported|generic)", 78, 0.95)
            add(f"cc-by{parts}-{version}", rf"creativecommons\.org/licenses/by{parts}/{v}", 79, 0.97)
        add(f"cc-by{parts}", short, 62, 0.8)
        add(f"cc-by{parts}", long, 62, 0.8)
    for label, name in (("gpl", r"gnu\s+general\s+public\s+licen[cs]e|\bgnu\s+gpl\b"), ("lgpl", r"gnu\s+(?:lesser|library)\s+general\s+public\s+licen[cs]e"), ("agpl", r"affero\s+general\s+public\s+licen[cs]e"), ("apache", r"\bapache\s+(?:software\s+)?licen[cs]e")):
        add(label, rf"(?:{name})", 50, 0.6)
    for label, priority, confidence, pattern in SIGNATURES:
        add(label, pattern, priority, confidence)
    return sorted(rules, key=lambda r: -r.priority)


class Scanner:
    def __init__(self, rules: list[Rule] | None = None, base: dict[str, str] | None = None):
        import ahocorasick

        self.rules = build_rules() if rules is None else rules
        self.compiled = [re.compile(r.pattern) for r in self.rules]
        by_word: dict[str, list[int]] = {}
        self.always = [i for i, r in enumerate(self.rules) if not r.keywords]
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                by_word.setdefault(k, []).append(i)
        self.gate = ahocorasick.Automaton()
        for k, which in by_word.items():
            self.gate.add_word(k, tuple(which))
        self.gate.make_automaton()
        self.base = {p.encode(): label for p, label in (BASE if base is None else base).items()}

    def detect(self, lower: str) -> list[tuple[int, int, Rule]]:
        """Kept detections (start, end, rule) of a text whose A-Z are lower-cased, by start."""
        run = set(self.always)
        for which in {w for _, w in self.gate.iter(lower)} if lower and len(self.gate) else ():
            run.update(which)
        found = [(m.start(), m.end(), i) for i in sorted(run) for m in self.compiled[i].finditer(lower)]
        found.sort(key=lambda x: (-self.rules[x[2]].priority, -(x[1] - x[0]), x[0], x[2]))
        kept: list[tuple[int, int, int]] = []
        place = {a: i + 1 for i, a in enumerate(sorted({a for a, _, _ in found}))}
        furthest = [0] * (len(place) + 1)  # a Fenwick tree: the greatest end of a kept interval that starts here or before
        for a, b, i in found:  # ordered by priority, so a kept one is never less than a later one
            at, end = place[a], 0
            while at:
                end, at = max(end, furthest[at]), at & (at - 1)
            if end < b:
                kept.append((a, b, i))
                at = place[a]
                while at < len(furthest):
                    furthest[at], at = max(furthest[at], b), at + (at & -at)
        return [(a, b, self.rules[i]) for a, b, i in sorted(kept)]

    def phrases(self, words: bytes) -> tuple[int, int | None, int | None, set[str]]:
        """Places of the base phrases in space-joined words: count, first and last word, labels."""
        n, first, last, labels = 0, None, None, set()
        padded = b" " + words + b" "
        for phrase, label in self.base.items():
            needle = b" " + phrase + b" "
            at, counted, word = padded.find(needle), 0, 0
            while at >= 0:
                word, counted = word + padded.count(b" ", counted, at), at
                n, first, last = n + 1, word if first is None else min(first, word), word if last is None else max(last, word)
                labels.add(label)
                at = padded.find(needle, at + 1)
        return n, first, last, labels


# Bytes that make words: digits, a-z after lower-casing, and all of other scripts.
_TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


SCAN_FIELDS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches, spans: bool):
    scanner = _scanner()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode().lower()
            words = raw.translate(_TO_WORDS).split()
            n, first, last, base = scanner.phrases(b" ".join(words))
            found = scanner.detect(raw.decode())
            labels = sorted(base | {r.label for _, _, r in found})
            score = max([*(r.confidence for _, _, r in found), 0.6 * bool(base)])
            row = [doc_id.as_py(), len(words), n, first, last, ",".join(sorted(base)), ",".join(labels), score]
            rows.append([*row, [{"start": a, "end": b, "label": r.label, "confidence": r.confidence} for a, b, r in found]] if spans else row)
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        names = [f.split()[0] for f in SCAN_FIELDS.split(", ")]
        if spans:
            types.append(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())])))
            names.append("detections")
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def scan_licenses(docs: DataFrame, *, spans: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, base phrases, labels and score.

    ``spans`` adds the kept detections with their places in characters. Null and empty texts have
    no words, no labels ("") and score 0. Repeated rows stay; an empty table gives no rows.
    """
    fields = SCAN_FIELDS + ", detections array<struct<start:int,end:int,label:string,confidence:double>>" * spans
    return docs.select("doc_id", "text").mapInArrow(partial(_scan, spans=spans), fields)


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
