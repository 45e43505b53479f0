"""Token counts by compiled finite-state transducers (operator 10).

Two machines, both deterministic and annotated with what a transition emits:

* the splitter reads character classes and emits the starts of pre-tokens. Texts are cut into chunks of
  equal length; every chunk is turned into a map (entry state -> exit state) for all entry states at once,
  the maps are composed by a parallel prefix scan, and the chunks then run from their true entry states.
* the byte machine reads a pre-token's bytes; a transition carries the number of tokens that it adds
  (or takes back) to the encoding of the bytes so far. Its state is the longest suffix that may still
  grow into a token, with the last token and the relative count at each place in it. States and
  transitions are compiled when first met. Whole pre-tokens are kept as shortcut transitions.

The counts equal the encoder's own: a byte-pair encoding is right exactly when each neighbouring pair of
tokens is, so the last token of each prefix is determined by those of shorter prefixes.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .shared import per_text

#: Entries of the byte machine and of its shortcuts; beyond this they are compiled afresh.
MAX_STATES, MAX_SHORTCUTS = 300_000, 600_000
CHUNK = 512

# The contractions of the byte-level pattern and the classes of characters the splitter tells apart.
CLASSES = ["suffix", "r", "v", "l", "e", "letter", "number", "other", "apostrophe", "space", "blank", "end"]
STATES = ["ended", "letters", "numbers", "others", "quote", "quote_r", "quote_v", "quote_l", "space", "blank", "spaces", "blanks"]
SUFFIXES = "stmd"


@cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    table = np.full(0x110000, CLASSES.index("other"), np.uint8)
    for pattern, name in ((r"\p{L}+", "letter"), (r"\p{N}+", "number"), (r"\s+", "blank")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = CLASSES.index(name)
    for c in SUFFIXES:
        table[ord(c)] = CLASSES.index("suffix")
    for c in "rvle":
        table[ord(c)] = CLASSES.index(c)
    table[ord("'")], table[ord(" ")] = CLASSES.index("apostrophe"), CLASSES.index("space")
    return table


@cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted starts for each state and class, at [state * 16 + class].

    Bit 0 of what is emitted: a pre-token starts at this character; bit 1: at the one before.
    """
    letters = {"suffix", "r", "v", "l", "e", "letter"}

    def fresh(c: str) -> str:
        if c in letters:
            return "letters"
        return {"number": "numbers", "other": "others", "apostrophe": "quote", "space": "space", "blank": "blank", "end": "ended"}[c]

    def move(s: str, c: str) -> tuple[str, int]:
        white = c in ("space", "blank")
        if c == "end":
            return "ended", 1 | 2 * (s in ("quote_r", "quote_v", "quote_l"))
        if s in ("letters", "numbers", "others"):
            stays = {"letters": letters, "numbers": {"number"}, "others": {"other", "apostrophe"}}[s]
            return (s, 0) if c in stays else (fresh(c), 1)
        if s == "quote":
            if c == "suffix":
                return "ended", 0
            if c in ("r", "v", "l"):
                return f"quote_{c}", 0
            return ("others", 0) if c in ("other", "apostrophe") else (fresh(c), 1)
        if s.startswith("quote_"):
            if c == {"r": "e", "v": "e", "l": "l"}[s[-1]]:
                return "ended", 0
            return ("letters", 2) if c in letters else (fresh(c), 3)
        if s in ("space", "blank", "spaces", "blanks"):
            if white:
                return ("spaces" if c == "space" else "blanks"), 0
            before = 2 * (s in ("spaces", "blanks"))
            if s in ("space", "spaces"):  # the last space joins what follows
                return ("others" if c == "apostrophe" else fresh(c)), before
            return fresh(c), before | 1
        return fresh(c), 1

    go, out = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for i, s in enumerate(STATES):
        for j, c in enumerate(CLASSES):
            to, emitted = move(s, c)
            go[i * 16 + j], out[i * 16 + j] = STATES.index(to) * 16, emitted
    return go, out


def starts_of(classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for one array of classes that ends with "end"."""
    go, out = splitter()
    n = len(classes)
    width = min(CHUNK, n)
    rows = -(-n // width)
    grid = np.full(rows * width, CLASSES.index("end"), np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    entry = np.zeros(rows, np.uint8)
    if rows > 1:
        maps = np.repeat((np.arange(len(STATES), dtype=np.uint8) * 16)[:, None], rows, 1)
        for column in grid:
            maps = go[maps | column]
        step = 1
        while step < rows:  # prefix scan: maps[:, k] becomes the map of all chunks up to k
            maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step] >> 4, 0)
            step *= 2
        entry[1:] = maps[0, :-1]  # texts begin in state 0
    marks = np.empty_like(grid)
    for k, column in enumerate(grid):
        at = entry | column
        marks[k], entry = out[at], go[at]
    marks = marks.T.reshape(-1)
    begun = (marks & 1).astype(bool)
    begun[:-1] |= (marks[1:] & 2).astype(bool)
    return np.flatnonzero(begun[:n])


def check(made: dict) -> None:
    """Raise on settings that the machines do not follow, rather than count otherwise than the library."""
    before, model = made.get("pre_tokenizer") or {}, made["model"]
    wrong = [k for k in ("normalizer", "truncation", "padding") if made.get(k)]
    wrong += [k for k, wanted in (("type", "ByteLevel"), ("add_prefix_space", False)) if before.get(k) != wanted]
    wrong += ["use_regex"] * (not before.get("use_regex", True))
    wrong += ["model type"] * (model.get("type", "BPE") != "BPE")
    wrong += [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [f"added token {t['content']!r}" for t in made["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if wrong:
        raise ValueError(f"the tokenizer has settings that are not supported: {', '.join(wrong)}")


class ByteMachine:
    """Counts the tokens of pre-tokens for a byte-level pair encoding, given as the content of a tokenizer's .json file."""

    def __init__(self, content: str):
        made = json.loads(content)
        check(made)
        self.special = [t["content"] for t in made["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        raw = lambda s: bytes(letter[c] for c in s)
        self.rank = {}
        for k, pair in enumerate(made["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((raw(left), raw(right)), k)
        self.tokens = {raw(t) for t in made["model"]["vocab"] if all(c in letter for c in t)}
        self.grows = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.made: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.spines: dict[tuple[bytes, int], list] = {}
        self.clear()
        self.shortcuts: dict[str, int] = {}

    def clear(self) -> None:
        start = (b"", (None,), (0,))
        self.ids, self.states, self.edges = {start: 0}, [start], {}

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The pair whose merge makes the token from its own bytes; None if they encode otherwise."""
        if token in self.made:
            return self.made[token]
        parts, last = [token[i : i + 1] for i in range(len(token))], None
        while len(parts) > 1:
            rank, at = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.made[token] = last if len(parts) == 1 else None
        return self.made[token]

    def whole(self, token: bytes) -> bool:
        """Whether the token's own bytes encode as this one token."""
        return len(token) == 1 or self.halves(token) is not None

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that stand at the token's left (0) or right (1) edge while it is merged: part, first and last time."""
        found = self.spines.get((token, side))
        if found is None:
            found, part, end = [], token, 1 << 30
            while True:
                pair = self.halves(part) if len(part) > 1 else None
                born = self.rank[pair] if pair else -1
                found.append((part, born, end))
                if not pair:
                    break
                part, end = pair[side], born
            self.spines[token, side] = found
        return found

    def fit(self, left: bytes, right: bytes) -> bool:
        """Whether left and right can be neighbours in an encoding: no merge across their border comes first."""
        found = self.fits.get((left, right))
        if found is None:
            found = True
            for a, born_a, end_a in self.edge(left, 1):
                for b, born_b, end_b in self.edge(right, 0):
                    if born_b >= end_a or born_a > end_b:
                        continue
                    rank = self.rank.get((a, b))
                    # of equal merges the leftmost is made first: the left part's own, but before the right part's own
                    if rank is not None and born_a < rank < end_a and born_b < rank <= end_b:
                        found = False
            if len(self.fits) > MAX_STATES:
                self.fits.clear()
            self.fits[left, right] = found
        return found

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from state by byte: next state and tokens added."""
        tail, last, counts = self.states[state]
        tail += bytes((byte,))
        for k in range(len(tail)):
            token = tail[k:]
            if token in self.tokens and (last[k] is None or self.fit(last[k], token)) and self.whole(token):
                added = counts[k] + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        last, counts = (*last, token), (*(c - added for c in counts), 0)
        cut = 0
        while cut < len(tail) and tail[cut:] not in self.grows:
            cut += 1
        key = (tail[cut:], last[cut:], counts[cut:])
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
        self.edges[state, byte] = to, added
        return to, added

    def count(self, piece: str) -> int:
        """Tokens of one pre-token."""
        state = total = 0
        edges = self.edges
        for byte in piece.encode():
            found = edges.get((state, byte))
            if found is None:
                found = self.compile(state, byte)
            state = found[0]
            total += found[1]
        if len(self.states) > MAX_STATES:
            self.clear()
        if len(piece) <= 64:
            if len(self.shortcuts) > MAX_SHORTCUTS:
                self.shortcuts.clear()
            self.shortcuts[piece] = total
        return total

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special tokens' strings count as the one token that the library makes of them."""
        import regex

        segments, owner, totals = [], [], [0] * len(texts)
        split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        for i, text in enumerate(texts):
            parts = split.split(text) if split else [text]
            totals[i] = len(parts) - 1
            for part in parts:
                if part:
                    segments.append(part)
                    owner.append(i)
        if not segments:
            return totals
        joined = "\0".join(segments) + "\0"
        classes = class_table()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        classes[ends] = CLASSES.index("end")
        starts = starts_of(classes)
        bounds = starts.tolist()
        firsts = np.searchsorted(starts, np.concatenate([[0], ends[:-1] + 1])).tolist()
        lasts = np.searchsorted(starts, ends).tolist()
        known, count = self.shortcuts.get, self.count
        for k, i in enumerate(owner):
            total = 0
            for at in range(firsts[k], lasts[k]):
                piece = joined[bounds[at] : bounds[at + 1]]
                n = known(piece)
                total += count(piece) if n is None else n
            totals[i] += total
        return totals


@cache
def machine_of(content: str) -> ByteMachine:
    return ByteMachine(content)


def machine(path: str) -> ByteMachine:
    with open(path, encoding="utf-8") as file:
        return machine_of(file.read())


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per document: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `tokenizer` is the path of a byte-level pair encoding's .json file, read here; its content (some megabytes, which
    its vocabulary bounds) goes to the workers. Raises on settings that the machines do not follow. A null or empty text has no bytes and no tokens; other columns of docs are ignored; repeated rows stay repeated.
    One pass over the rows, no shuffle; a worker holds one block of texts and the bounded machines.
    """

    machine(tokenizer)  # settings are checked before any task runs
    with open(tokenizer, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(texts: list[str]) -> list[list]:
        n = machine_of(content.value).counts(texts)
        return [[len(t.encode()) for t in texts], n, [x > limit for x in n]]

    return per_text(docs, [key], text, "n_bytes bigint, n_tokens bigint, over_limit boolean", work)
