"""Quality rules as a short-circuit cascade (operator 12).

Every rule is a limit on one measure of a text and comes with nothing known
about its price.  A sample of the documents is measured in Spark tasks: the
seconds each measure takes and, for each set of rules that fail together,
the number of texts.  From these counts the cascade is ordered greedily: the
next rule is the one that rejects most, of what the rules before it leave,
per second.  Over all documents the rules then run in that order on whole
texts, and a text that one rule rejects is not measured by those after it.
The order changes the cost alone: a text is kept if it passes every rule.

Base counts (words, symbols, repeated lines and windows) are results of
their own and are taken for every text; texts that fail on them enter no
rule.  Nulls and empty texts have no words and fail the base.  Texts of more
than ``BLOCK_BYTES`` are measured block by block, cut at white space, so
that a task's memory is bounded by the hashes of a text's words.  Rows keep
their multiplicity; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.sampling import bounded_sample
from quarry.llm.spans import mix, prefix_hash, range_hash, runs_of

#: text measured at a time
BLOCK_BYTES = 1 << 19
_WHITE = bytes([9, 10, 11, 12, 13, 32])
#: every white space becomes a space; case is kept
_SPACED = bytes(32 if c in _WHITE else c for c in range(256))


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL = _set("#*$%&|<>")
_UPPER = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _set("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _set("0123456789")
_LETTER = _UPPER | _LOWER | (np.arange(256) >= 128)
_MARK = (np.arange(256) > 32) & (np.arange(256) < 127) & ~_LETTER & ~_DIGIT
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80  # the first byte of a character
_SPACE = _set("".join(map(chr, _WHITE)))


def _cut(text: bytes) -> list[bytes]:
    """The text in blocks of about ``BLOCK_BYTES``, cut where white space begins (a longer word is not cut)."""
    out, at = [], 0
    while len(text) - at > BLOCK_BYTES:
        end = at + BLOCK_BYTES
        ends = [e for e in (text.rfind(c, at + 1, end) for c in (b" ", b"\n", b"\t")) if e > 0]
        if not ends:
            ends = [min((e for e in (text.find(c, end) for c in (b" ", b"\n", b"\t")) if e > 0), default=len(text))]
        out.append(text[at:max(ends)])
        at = max(ends)
    return [*out, text[at:]]


class Block:
    """Some texts, or a part of one, as one buffer with its words."""

    def __init__(self, rows: list[bytes]):
        self.buf = np.frombuffer(b" " + b" ".join(rows).translate(_SPACED) + b" ", dtype=np.uint8)
        edge = np.flatnonzero(np.diff((self.buf != 32).view(np.int8)))
        self.start, self.end = edge[0::2] + 1, edge[1::2] + 1
        self.limits = np.cumsum([0] + [len(r) + 1 for r in rows])  # text i: bytes limits[i] to limits[i + 1]
        self.word_limits = np.searchsorted(self.start, self.limits, side="left")

    def bytes_where(self, table: np.ndarray) -> np.ndarray:
        return self.marks(table[self.buf])

    def marks(self, hit: np.ndarray) -> np.ndarray:
        """Number of marked bytes a text."""
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[self.limits[1:]] - total[self.limits[:-1]]

    def words_where(self, hit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[self.word_limits[1:]] - total[self.word_limits[:-1]]

    def in_words(self, hit: np.ndarray) -> np.ndarray:
        """Number of marked bytes a word."""
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[self.end] - total[self.start]


class Texts:
    """Whole texts; counts are added up over blocks."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows
        self._only: Block | None = None

    def __len__(self) -> int:
        return len(self.rows)

    def blocks(self) -> Iterator[tuple[Block, np.ndarray]]:
        """Blocks and the text of each of their rows."""
        if self._only is None and sum(map(len, self.rows)) <= BLOCK_BYTES + len(self.rows):
            self._only = Block(self.rows)
        if self._only is not None:
            yield self._only, np.arange(len(self.rows))
            return
        for i, row in enumerate(self.rows):
            for part in _cut(row):
                yield Block([part]), np.array([i])

    def add(self, count: Callable[[Block], np.ndarray]) -> np.ndarray:
        out = np.zeros(len(self.rows), dtype=np.int64)
        for block, rows in self.blocks():
            np.add.at(out, rows, count(block))
        return out

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, case kept, and each text's first place in them."""
        found, sizes = [], np.zeros(len(self.rows), dtype=np.int64)
        for block, rows in self.blocks():
            found.append(range_hash(prefix_hash(block.buf), block.start, block.end))
            np.add.at(sizes, rows, np.diff(block.word_limits))
        return np.concatenate([*found, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words[1])

    @cached_property
    def lines(self) -> list[list[bytes]]:
        """Lines with a word."""
        return [[x for x in r.split(b"\n") if x.strip()] for r in self.rows]

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.add(lambda b: b.bytes_where(_CODE_POINT & ~_SPACE))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.add(lambda b: b.bytes_where(_SYMBOL))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return np.array([len(x) - len(set(x)) for x in self.lines], dtype=np.int64)

    def n_repeat_words(self, k: int = 5) -> np.ndarray:
        """Words in windows of ``k`` words found twice or more in the text."""
        words, at = self.words
        windows = runs_of(words, k)
        owner = np.repeat(np.arange(len(self.rows), dtype=np.uint64), np.diff(at))
        inside = owner[:len(windows)] == owner[len(words) - len(windows):]
        place = np.flatnonzero(inside)
        key = mix(windows[place] ^ mix(owner[place] + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(place), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(step, place[twice], 1)
        np.add.at(step, place[twice] + k, -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
        return total[at[1:]] - total[at[:-1]]

    def take(self, keep: np.ndarray) -> Texts:
        return Texts([self.rows[i] for i in np.flatnonzero(keep)])


@dataclass(frozen=True)
class Rule:
    """A text fails where ``measure`` is under ``low`` or over ``high``."""

    name: str
    measure: Callable[[Texts], np.ndarray]
    low: float = -np.inf
    high: float = np.inf

    def fails(self, texts: Texts) -> np.ndarray:
        v = self.measure(texts)
        return (v < self.low) | (v > self.high)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _shouting(t: Texts) -> np.ndarray:
    return _share(t.add(lambda b: b.bytes_where(_UPPER)), t.add(lambda b: b.bytes_where(_UPPER | _LOWER)))


def _lettered(t: Texts) -> np.ndarray:
    return _share(t.add(lambda b: b.words_where(b.in_words(_LETTER[b.buf]) > 0)), t.n_words)


def _bursts(t: Texts) -> np.ndarray:
    """Share of words with two punctuation marks side by side."""
    def count(b: Block) -> np.ndarray:
        mark = _MARK[b.buf]
        return b.words_where(b.in_words(mark & np.append(mark[1:], False)) > 0)
    return _share(t.add(count), t.n_words)


def _stutter(t: Texts) -> np.ndarray:
    """Share of words that repeat the word before them."""
    words, at = t.words
    same = np.concatenate([[False], words[1:] == words[:-1]])[:len(words)]
    first = at[:-1][np.diff(at) > 0]
    same[first] = False
    total = np.concatenate([[0], np.cumsum(same)])
    return _share(total[at[1:]] - total[at[:-1]], np.diff(at))


def _variety(t: Texts) -> np.ndarray:
    """Distinct words by the square root of the words."""
    words, at = t.words
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at[:-1], at[1:])], dtype=np.int64)
    return distinct / np.sqrt(np.maximum(np.diff(at), 1))


def _line_share(hit: Callable[[bytes], bool]) -> Callable[[Texts], np.ndarray]:
    def share(t: Texts) -> np.ndarray:
        return np.array([sum(map(hit, x)) / max(1, len(x)) for x in t.lines])
    return share


def _trails_off(line: bytes) -> bool:
    return line.rstrip().endswith((b"...", "…".encode()))


def _bullet(line: bytes) -> bool:
    return line.lstrip().startswith((b"* ", b"- ", "• ".encode()))


#: production rules; limits leave room for tables of numbers, short notes and very long texts
RULES = (
    Rule("symbols a word", lambda t: _share(t.n_symbols, t.n_words), high=0.1),
    Rule("word length", lambda t: _share(t.word_chars, t.n_words), low=2, high=16),
    Rule("repeated lines", lambda t: _share(t.n_dup_lines, np.array([len(x) for x in t.lines])), high=0.5),
    Rule("capital letters", _shouting, high=0.5),
    Rule("digits", lambda t: _share(t.add(lambda b: b.bytes_where(_DIGIT)), t.word_chars), high=0.5),
    Rule("words with a letter", _lettered, low=0.5),
    Rule("bursts of punctuation", _bursts, high=0.3),
    Rule("repeated words", _stutter, high=0.3),
    Rule("variety of words", _variety, low=1),
    Rule("lines that trail off", _line_share(_trails_off), high=0.5),
    Rule("bullet lines", _line_share(_bullet), high=0.95),
)


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    out = {"n_words": t.n_words, "word_chars": t.word_chars, "n_symbols": t.n_symbols, "n_dup_lines": t.n_dup_lines, "n_repeat_words": t.n_repeat_words()}
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    return out


def _groups(rows: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``BLOCK_BYTES`` in all; a longer text alone."""
    first, size = 0, 0
    for i, r in enumerate(rows):
        if size and size + len(r) > BLOCK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(r)
    if first < len(rows):
        yield first, len(rows)


def _profile(rules: tuple[Rule, ...]):
    """Per task: seconds of each rule on fresh texts, and counts by the set of rules that fail (a bit a rule)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seconds = np.zeros(len(rules))
        sets: dict[int, int] = {}
        for pdf in batches:
            rows = [t or b"" for t in pdf["text"]]
            for first, last in _groups(rows):
                base = Texts(rows[first:last])
                alive = base.take(~base_counts(base)["base_failed"])
                base_counts(alive)  # a cascade finds the base counts taken
                bits = np.zeros(len(alive), dtype=np.int64)
                for j, rule in enumerate(rules):
                    began = time.perf_counter()
                    bits |= rule.fails(alive).astype(np.int64) << j
                    seconds[j] += time.perf_counter() - began
                for b, n in zip(*np.unique(bits, return_counts=True)):
                    sets[int(b)] = sets.get(int(b), 0) + int(n)
        yield pd.DataFrame({"kind": ["seconds"] * len(rules) + ["texts"] * len(sets),
                            "key": [*range(len(rules)), *sets], "value": [*seconds, *map(float, sets.values())]})
    return run


def order_rules(seconds: np.ndarray, sets: dict[int, int]) -> list[int]:
    """Greedy order: most texts rejected, of those still there, per second.

    ``sets`` counts texts by the bits of the rules they fail.  Rules that
    reject nothing more come last, cheapest first; ties go to the earlier rule.
    """
    left, order, total = dict(sets), [], max(1, sum(sets.values()))
    todo = list(range(len(seconds)))
    while todo:
        share = sum(left.values()) / total  # a rule costs as much as texts reach it
        rejected = {j: sum(n for b, n in left.items() if b >> j & 1) for j in todo}
        best = min(todo, key=lambda j: (-rejected[j] / max(seconds[j] * share, 1e-12), seconds[j], j))
        order.append(best)
        todo.remove(best)
        left = {b: n for b, n in left.items() if not b >> best & 1}
    return order


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 2000) -> list[int]:
    """Order of ``rules`` by cost and selectivity over about ``sample`` documents, a bounded number; verdicts do not depend on it."""
    src = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = bounded_sample(src, F.xxhash64("doc_id", "text"), sample).select("text")
    rows = (texts.mapInPandas(_profile(rules), "kind string, key int, value double")
            .groupBy("kind", "key").agg(F.sum("value").alias("value")).collect())  # rules and at most 2 ^ rules sets
    seconds = np.zeros(len(rules))
    for r in rows:
        if r["kind"] == "seconds":
            seconds[r["key"]] = r["value"]
    return order_rules(seconds, {r["key"]: int(r["value"]) for r in rows if r["kind"] == "texts"})


def run_cascade(texts: Texts, rules: tuple[Rule, ...], order: list[int], alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the rule that rejected it (-1: none) and how many rules measured it; only ``alive`` texts enter."""
    failed, measured = np.full(len(texts), -1, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    at = np.flatnonzero(alive)
    left = texts if len(at) == len(texts) else texts.take(alive)
    for j in order:
        if not len(at):
            break
        bad = rules[j].fails(left)
        measured[at] += 1
        failed[at[bad]] = j
        if bad.any():
            at, left = at[~bad], left.take(~bad)
    return failed, measured


def _judge(rules: tuple[Rule, ...], order: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array([r.name for r in rules] + [None], dtype=object)
        for pdf in batches:
            rows = [t or b"" for t in pdf["text"]]
            for first, last in _groups(rows):
                t = Texts(rows[first:last])
                base = base_counts(t)
                failed, measured = run_cascade(t, rules, order, ~base["base_failed"])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].array[first:last], **base, "kept": ~base["base_failed"] & (failed < 0),
                                    "failed_rule": names[failed], "rules_measured": measured})
    return run


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 2000) -> DataFrame:
    """doc_id, base counts, base_failed, kept, failed_rule (the first of the cascade's order), rules_measured of every row of (doc_id, text)."""
    order = plan_cascade(docs, rules, sample)
    kind = dict(docs.dtypes)["doc_id"]
    return (docs.select("doc_id", F.col("text").cast("binary").alias("text"))
            .mapInPandas(_judge(rules, order), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                         "n_repeat_words long, base_failed boolean, kept boolean, failed_rule string, rules_measured long"))
