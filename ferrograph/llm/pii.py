"""Personal data behind disguises (operator 9).

Plain e-mail addresses, IP numbers, card and phone numbers are found in the text as it stands. A transducer then
rewrites disguises (homoglyphs, spelled digits, "(at)" and "dot") and remembers for each character written where it
was read; identifiers that only the rewritten text shows are mapped back to source characters and added.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from functools import cache

from pyspark.sql import DataFrame

from .shared import per_text

KINDS = ["email", "ip", "card", "phone"]

# Letters of other scripts that look like Latin ones, and invisible characters.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝқӏАВЕКМНОРСТУХІЈЅ" + "αοριυνκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "‐‑‒–−∙․・。",
        "aeopcyxijshdqwklABEKMHOPCTYXIJS" + "aopiuvkABEZHIKMNOPTYX" + "-----....",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
# The digits from zero, spelled in the languages of the corpus.
SPELLED = [
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
]
# How the at sign, the dot and the plus sign are spelled.
AT, DOT, PLUS = "at|arobase|arroba|ät", "dot|point|punkt|punto|period", "plus|más"

# The last labels that an address needs if its signs are bare words.
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|eu|uk|us|de|fr|es|it|nl|ch|at|be|example|test"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT_WORDS = {w: str(i) for line in SPELLED for i, w in enumerate(line.split())} | {"oh": "0"}
WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
TIMES = {"double": 2, "triple": 3}
ONE = rf"(?:(?:double|triple)[ -]+)?(?:{WORD})"
RUN = re.compile(rf"(?<!\w)(?:(?:{PLUS})[ -]+)?{ONE}(?:[ ,-]+(?:(?:{ONE}|{DOT})(?!\w)|[0-9](?![0-9]))){{3,}}", re.I)
PART = re.compile(rf"(?:(double|triple)[ -]+)?({WORD})|({DOT})|({PLUS})|[0-9]|[ ,-]+", re.I)
BRACKET = re.compile(rf"[\[({{<]\s*(?:({AT}|@)|(?:{DOT}|\.))\s*[\])}}>]\s*", re.I)
ENTITY = re.compile(r"&(?:#0*64|#x0*40|commat);|&(?:#0*46|#x0*2e|period);", re.I)
PLAIN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?P<at>[ _]+(?:{AT})[ _]+|@)(?:[A-Za-z0-9-]++[ _]+(?:{DOT})[ _]+)+(?:{ENDINGS})(?![A-Za-z0-9-])", re.I)
# "name at host.com" is read as an address only if the name does not look like a word of a sentence
HALF = re.compile(rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9]*[0-9._+])[A-Za-z0-9._%+-]++(?P<at> (?:{AT}) )(?:[A-Za-z0-9-]++\.)+(?:{ENDINGS})(?![A-Za-z0-9-])", re.I)
APART = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?P<at> ?@ ?)[A-Za-z0-9-]++(?: ?\. ?[A-Za-z0-9-]++)* ?\. ?(?:{ENDINGS})(?![A-Za-z0-9-])")
GROUPS = re.compile(r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
LETTER = re.compile(r"(?<=[0-9])[OoIl](?=[0-9])")
TOKEN, BARE_DOT = re.compile(r"[^\W_]+"), re.compile(rf"[ _](?:{DOT})[ _]")
HALF_SIGN, SPACED_DOT = re.compile(rf" (?:{AT}) [A-Za-z0-9-]+\.", re.I), re.compile(r" ?\. ?")
PLAIN_DOT = re.compile(rf"[ _]+(?:{DOT})[ _]+", re.I)


@cache
def glyphs() -> dict[str, str]:
    """What each disguised character stands for ("" if invisible): the lists above, and all that compatibility forms give."""
    table = LOOKALIKES | dict.fromkeys(INVISIBLE, "")
    for code in range(0x80, 0x20000):
        plain = unicodedata.normalize("NFKC", chr(code)) if not 0xD800 <= code < 0xE000 else ""
        if len(plain) == 1 and (" " < plain <= "~"):
            table.setdefault(chr(code), plain)
        elif unicodedata.decimal(chr(code), None) is not None:
            table.setdefault(chr(code), str(unicodedata.decimal(chr(code))))
    return table


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of identifiers as they stand, by kind, then start."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            found.append((0, start, done))
        at = text.find("@", m.end() if m else at + 1)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub(r"[\x20-]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


class Written:
    """A text under rewriting: written characters, and for each the source range it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, range(len(text)), range(1, len(text) + 1), set()

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply (start, end, new) edits, in order and apart."""
        text, starts, ends, changed, at, marks = [], [], [], set(), 0, sorted(self.changed)
        size = 0

        def keep(to: int) -> None:
            nonlocal size
            text.append(self.text[at:to])
            starts.extend(self.starts[at:to])
            ends.extend(self.ends[at:to])
            for k in marks[bisect.bisect_left(marks, at) : bisect.bisect_left(marks, to)]:
                changed.add(size + k - at)
            size += to - at

        for start, end, new in edits:
            keep(start)
            text.append(new)
            starts.extend([self.starts[start]] * len(new))
            ends.extend([self.ends[end - 1]] * len(new))
            changed.update(range(size, size + len(new)))
            if not new:
                changed.add(size)
            size += len(new)
            at = end
        keep(len(self.text))
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, changed


def spelled(run: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn a run of spelled digits into digits: separators go."""
    edits = []
    for m in PART.finditer(run[0]):
        low = m[0].lower()
        new = DIGIT_WORDS[m[2].lower()] * TIMES.get((m[1] or "").lower(), 1) if m[2] else "." if m[3] else "+" if m[4] else low if low.isdigit() else ""
        if new != m[0]:
            edits.append((run.start() + m.start(), run.start() + m.end(), new))
    return edits


def rewritings(written: Written):
    """The edits of each further disguise, one after another, each on what the last has left."""
    digit = {"O": "0", "o": "0", "I": "1", "l": "1"}
    yield [(m.start(), m.end(), "@" if re.search("64|40|commat", m[0], re.I) else ".") for m in (ENTITY.finditer(written.text) if "&" in written.text else ())]
    edits = []
    for m in PLAIN.finditer(written.text) if BARE_DOT.search(written.text.lower()) else ():
        edits.append((*m.span("at"), "@"))
        edits += [(d.start(), d.end(), ".") for d in PLAIN_DOT.finditer(written.text, m.end("at"), m.end())]
    yield edits
    yield [(*m.span("at"), "@") for m in HALF.finditer(written.text)] if HALF_SIGN.search(written.text) else []
    edits = []
    for m in APART.finditer(written.text) if "@" in written.text else ():
        if " " in m[0]:
            edits.append((*m.span("at"), "@"))
            edits += [(*d.span(), ".") for d in SPACED_DOT.finditer(written.text, m.end("at"), m.end())]
    yield edits
    yield [(m.start() + k, m.start() + k + 1, "-") for m in GROUPS.finditer(written.text) for k in (4, 9, 14)]
    yield [(m.start(), m.end(), digit[m[0]]) for m in LETTER.finditer(written.text)]


def hidden_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in source characters of identifiers that only the rewritten text shows."""
    written, touched = Written(text), False
    if not text.isascii() and not glyphs().keys().isdisjoint(text):
        table = glyphs()
        written.rewrite([(i, i + 1, table[c]) for i, c in enumerate(text) if c in table])
        touched = True
    none = DIGIT_WORDS.keys().isdisjoint(TOKEN.findall(written.text.lower()))  # no run, which spares the costly pattern
    edits = [] if none else [e for run in RUN.finditer(written.text) for e in spelled(run)]
    if edits:
        written.rewrite(edits)
        touched = True
    edits, done = [], 0
    for m in BRACKET.finditer(written.text):
        start = done + len(written.text[done : m.start()].rstrip())
        done = m.end()
        edits.append((start, done, "@" if m[1] else "."))
    if edits:
        written.rewrite(edits)
        touched = True
    for edits in map(list, rewritings(written)):
        if edits:
            written.rewrite(edits)
            touched = True
    if not touched:
        return []
    marks, found = sorted(written.changed), []
    for kind, start, end in plain_spans(written.text):
        k = bisect.bisect_left(marks, start)
        if k < len(marks) and marks[k] < end:
            found.append((kind, written.starts[start], written.ends[end - 1]))
    return found


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and those that the rewriting adds: none that a plain span of its kind already covers."""
    base = plain_spans(text)
    starts: list[list[int]] = [[] for _ in KINDS]
    ends: list[list[int]] = [[] for _ in KINDS]
    for kind, start, end in sorted(base):  # spans of a kind do not overlap
        starts[kind].append(start)
        ends[kind].append(end)
    added = []
    for kind, start, end in hidden_spans(text):
        last = bisect.bisect_right(starts[kind], start) - 1
        if last < 0 or ends[kind][last] < end:
            added.append((kind, start, end))
    return base, added


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key; n_email, n_ip, n_card, n_phone (plain spans); base_sha256 of the plain spans; spans (all); n_added.

    A span is kind:start:end in code points, end exclusive; spans are ordered by kind (email, ip, card, phone), then
    start. Null and empty texts have none (the hash is that of ""). Repeated rows are judged each by itself, other
    columns are ignored. One pass, no shuffle; the work on a text is linear in its length but for the sorting of its spans.
    """

    def work(texts: list[str]) -> list[list]:
        out: list[list] = [[] for _ in range(7)]
        for t in texts:
            base, added = spans(t)
            for kind in range(4):
                out[kind].append(sum(x[0] == kind for x in base))
            out[4].append(hashlib.sha256(shown(base).encode()).hexdigest())
            out[5].append(shown(base + added))
            out[6].append(len(added))
        return out

    schema = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return per_text(docs, [key], text, schema, work)
