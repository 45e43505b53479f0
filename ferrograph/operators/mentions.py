"""Mentions of a lexicon's aliases in texts, with spans: a multi-word automaton, context as bonus, greedy longest choice."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.notation import ELEMENTS

#: What the automaton reads: runs of ASCII letters and digits, runs of white space, and every other character by itself.
TOKEN = re.compile(r"[A-Za-z0-9]+|\s+|[^A-Za-z0-9\s]")
FORMULA = re.compile(r"(?<![A-Za-z0-9_])(?:[A-Z][a-z]?[0-9]*){2,}[+-]?(?![A-Za-z0-9_])")
SYMBOL = re.compile(r"([A-Z][a-z]?)[0-9]*")
# Scores of canonical names, other aliases and formulas, the bonus of a context, and how far it reaches.
CANONICAL, ALIAS, FORMULA_SCORE, BONUS, REACH, TOP = 0.96, 0.90, 0.62, 0.04, 32, 0.99
DASHES = re.compile("[‐‑‒–—]")
#: Characters that a lexicon may hold, as it is broadcast.
MOST = 20_000_000
#: Mentions that a task holds before it hands them on.
HELD = 2048


def folded(text: str) -> str:
    """Compatibility form, plain dashes, one space between words, lower case."""
    return " ".join(DASHES.sub("-", unicodedata.normalize("NFKC", text)).split()).lower()


class Automaton:
    """A trie of aliases' tokens with failure links: one pass over a text finds every alias, overlapping ones too."""

    def __init__(self, aliases: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]  # by state: alias and its number of tokens
        for k, alias in enumerate(aliases):
            tokens, at = self.tokens(alias.strip()), 0
            for t in tokens:
                at = self.next[at].setdefault(t, len(self.next))
                if at == len(self.next):
                    self.next.append({})
                    self.ends.append([])
            if tokens:
                self.ends[at].append((k, len(tokens)))
        self.fail = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:  # breadth first, so that a state's failure is known before its children's
            at = queue.popleft()
            for t, child in self.next[at].items():
                back = self.fail[at]
                while back and t not in self.next[back]:
                    back = self.fail[back]
                found = self.next[back].get(t, 0)
                self.fail[child] = found if found != child else 0
                self.ends[child] += self.ends[self.fail[child]]
                queue.append(child)

    @staticmethod
    def tokens(text: str) -> list[str]:
        return [" " if t.isspace() else t.lower() for t in TOKEN.findall(text)]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(alias, start, end) of every alias that neither begins nor ends within a run of ASCII letters and digits."""
        found, at, state, starts = [], 0, 0, []
        following, fail, ends = self.next, self.fail, self.ends
        raw = TOKEN.findall(text)
        for i, t in enumerate(raw):
            starts.append(at)
            at += len(t)
            t = " " if t.isspace() else t.lower()
            while state and t not in following[state]:
                state = fail[state]
            state = following[state].get(t, 0)
            for alias, n in ends[state]:
                found.append((alias, starts[i - n + 1], at, i - n + 1, i))
        plain = lambda i: 0 <= i < len(raw) and raw[i][0].isascii() and raw[i][0].isalnum()
        return [(k, a, b) for k, a, b, i, j in found if not plain(i - 1) and not plain(j + 1)]


def is_formula(text: str) -> bool:
    plain = text.rstrip("+-") if text[-1] in "+-" else text
    symbols = SYMBOL.findall(plain)
    return len(symbols) > 1 and any(c.isdigit() for c in plain) and all(s in ELEMENTS for s in symbols)


def greedy(spans: list[tuple]) -> set[int]:
    """Places of a choice without overlaps among spans (start, end, score): longest first, then the greater score, the earlier start, the earlier place."""
    taken: list[tuple[int, int]] = []
    chosen = set()
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][0] - spans[i][1], -spans[i][2], spans[i][0], i)):
        start, end = spans[i][:2]
        at = bisect_left(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            insort(taken, (start, end))
            chosen.add(i)
    return chosen


def lexicon_mentions(docs: DataFrame, key: str, text: str, lexicon: DataFrame, context: list[str] = (), formulas: bool = True, overlapping: bool = False) -> DataFrame:
    """Mentions of a lexicon's aliases: key, start, end (code points, end exclusive), mention, name, entry, category, source, score, chosen.

    The lexicon has rows (entry, name, alias, category, and optionally score); an alias that is its entry's name is
    `canonical`. An alias matches in any case, its spaces any white space, and not within a run of ASCII letters and
    digits. Its score is the lexicon's or .96 for canonical and .90 for other aliases, and .04 more (.99 at most) if one of
    the context words occurs within 32 characters around. With formulas, texts of two or more element symbols and a count
    are mentions too. Chosen are the longest mentions that do not overlap (ties: score, then start); others are left
    out unless `overlapping`. Null texts and texts without mentions give no row.

    The lexicon goes to every task, so it may hold 20 million characters at most (else ValueError); texts are read in one
    pass each, whatever the number of aliases, and nothing is shuffled. A task holds one batch of texts, and the mentions of
    one text and of `HELD` more.
    """
    columns = ["entry", "name", "alias", "category", *(["score"] if "score" in lexicon.columns else [])]
    size = lexicon.agg(F.sum(F.length("alias"))).first()[0] or 0
    if size > MOST:
        raise ValueError(f"the lexicon has {size} characters, more than {MOST}")
    entries = [r.asDict() for r in lexicon.select(columns).where("trim(alias) <> ''").distinct().orderBy(*columns).collect()]
    entries.sort(key=lambda r: -len(r["alias"]))  # as ties go to the earlier place
    shared = docs.sparkSession.sparkContext.broadcast((entries, [folded(w) for w in context]))
    kind = docs.schema[key].dataType.simpleString()
    machine: list[Automaton] = []

    def scored(base: float, text: str, start: int, end: int, words: list[str]) -> float:
        around = folded(text[max(0, start - REACH) : end + REACH]) if words else ""
        return min(TOP, max(0.0, round(base + BONUS * any(w in around for w in words), 3)))

    def run(batches):
        entries, words = shared.value
        if not machine:
            machine.append(Automaton(r["alias"] for r in entries))
        names = ["key", "start", "end", "mention", "name", "entry", "category", "source", "score", "chosen"]
        types = [None, pa.int32(), pa.int32(), *[pa.string()] * 5, pa.float64(), pa.bool_()]
        rows: list[list] = [[] for _ in names]
        owner: list[int] = []

        def handed(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = batch.column(0).take(pa.array(owner, pa.int64()))
            made = pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(rows[1:], types[1:], strict=True))], names)
            for column in (owner, *rows):
                column.clear()
            return made

        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                if not value.is_valid:
                    continue
                t = value.as_py()
                found = []
                for k, a, b in machine[0].spans(t):
                    r = entries[k]
                    canonical = r["alias"] == r["name"]
                    base = r.get("score") if r.get("score") is not None else CANONICAL if canonical else ALIAS
                    found.append((a, b, scored(base, t, a, b, words), k, r["name"], r["entry"], r["category"], "canonical" if canonical else "alias"))
                found.sort(key=lambda s: s[3])
                if formulas:
                    found += [(m.start(), m.end(), scored(FORMULA_SCORE, t, m.start(), m.end(), words), -1, m[0], None, "unknown", "formula") for m in FORMULA.finditer(t) if is_formula(m[0])]
                chosen = greedy(found)
                for n, (a, b, s, _, name, entry, category, source) in enumerate(found):
                    if overlapping or n in chosen:
                        owner.append(i)
                        for column, v in zip(rows[1:], (a, b, t[a:b], name, entry, category, source, s, n in chosen), strict=True):
                            column.append(v)
                if len(owner) >= HELD:
                    yield handed(batch)
            if owner:
                yield handed(batch)

    schema = f"key {kind}, start int, end int, mention string, name string, entry string, category string, source string, score double, chosen boolean"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("key", key)
