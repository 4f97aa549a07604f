"""License wording found by template matching.

1. Each template is compiled to a token automaton: a mandatory word is an edge, an optional region a way around its
   edges, a replaceable region a row of edges that any word passes. All templates are one automaton.
2. Texts are cut to words; a word is its number among the templates' words, or none. A match may begin where two words in
   a row are a way into a template; all other places are passed over by array operations.
3. From each such place the automaton runs on until no way is left. Sets of states become single states as they are
   met, so that a step is one look-up, and later texts use what earlier ones met.

A text is accepted for a label where all mandatory words of a template follow each other, with nothing between them
but what its regions allow. ``score`` is the greatest share of a template's mandatory words that a place went through in
order: 1 for an accepted text, 0 where nothing begins a template. A text is read once and nothing moves. Time is
linear in the text, times the length of the templates at worst; memory is a batch.

Defined cases: null and empty texts have no words, no label and score 0; ids may be null or repeat, each row gives a
row; of matches of one label that begin at one word the longest counts; very long texts are read whole; an empty table gives
an empty result; only ``key`` and ``text`` are read, other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docwarden.llm.common import small_batches
from docwarden.llm.license_templates import PHRASES, TEMPLATES
from docwarden.llm.word_arrays import LOWER, MARKS, split_words

TAG = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NO_WORD = -1


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def parse(template: str) -> list:
    """Markup -> nested parts: a word, (least, most) of any words, or a list that may be absent."""
    open_parts: list[list] = [[]]
    at = 0
    for tag in [*TAG.finditer(template), None]:
        open_parts[-1].extend(words_of(template[at : tag.start() if tag else len(template)]))
        if tag is None:
            break
        at = tag.end()
        if tag[1] == "beginOptional":
            open_parts.append([])
        elif tag[1] == "endOptional":
            if len(open_parts) == 1:
                raise ValueError("an optional region ends that did not begin")
            inner = open_parts.pop()
            open_parts[-1].append(inner)
        else:
            spec = dict(part.split("=", 1) for part in tag[1].split(";")[1:])
            least, most = map(int, spec["words"].split("-"))
            if not 0 <= least <= most:
                raise ValueError(f"no such number of words: {spec['words']}")
            open_parts[-1].append((least, most))
    if len(open_parts) > 1:
        raise ValueError("an optional region does not end")
    return open_parts[0]


@dataclass
class Automaton:
    """States of all templates: by word, by any word, and without a word. State 0 leads to every template."""

    by_word: list[dict[str, int]] = field(default_factory=lambda: [{}])
    by_any: list[int | None] = field(default_factory=lambda: [None])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    share: list[float] = field(default_factory=lambda: [0.0])
    label: list[str | None] = field(default_factory=lambda: [None])

    def state(self, share: float) -> int:
        for column, value in ((self.by_word, {}), (self.by_any, None), (self.free, []), (self.share, share), (self.label, None)):
            column.append(value)
        return len(self.share) - 1

    def add(self, label: str, template: str) -> None:
        parts = parse(template)
        mandatory = sum(isinstance(p, str) for p in parts)
        if not mandatory:
            raise ValueError(f"no mandatory word in a template of {label}")
        done = 0

        def chain(at: int, parts: list, counted: bool) -> int:
            nonlocal done
            for part in parts:
                if isinstance(part, str):
                    done += counted
                    after = self.state(done / mandatory)
                    self.by_word[at][part] = after
                elif isinstance(part, tuple):
                    after = self.state(done / mandatory)
                    for n in range(part[1]):
                        if n >= part[0]:
                            self.free[at].append(after)
                        step = self.state(done / mandatory)
                        self.by_any[at] = step
                        at = step
                    self.free[at].append(after)
                else:
                    after = self.state(done / mandatory)
                    inside = self.state(done / mandatory)
                    self.free[at] += [inside, after]
                    self.free[chain(inside, part, False)].append(after)
                at = after
            return at

        begin = self.state(0.0)
        self.free[0].append(begin)
        # a state of its own at the end, so that no edge leaves an accepted one
        end = chain(begin, parts, True)
        last = self.state(1.0)
        self.free[end].append(last)
        self.label[last] = label

    def closed(self, states: Sequence[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def after(self, states: frozenset[int], word: str | None) -> frozenset[int]:
        """States behind ``word``; None is a word that no template has."""
        moved = {self.by_any[s] for s in states if self.by_any[s] is not None}
        if word is not None:
            moved |= {self.by_word[s][word] for s in states if word in self.by_word[s]}
        return self.closed(list(moved))


class Matcher:
    """The automaton with its sets of states as single states, made when they are first met."""

    def __init__(self, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), phrases: Sequence[tuple[str, str]] = tuple(PHRASES)) -> None:
        self.automaton = Automaton()
        for label, template in templates:
            self.automaton.add(label, template)
        self.phrases = [(label, words_of(phrase)) for label, phrase in phrases]
        vocabulary = {w for edges in self.automaton.by_word for w in edges} | {w for _, ws in self.phrases for w in ws}
        self.words = sorted(vocabulary)
        self.number = {w.encode(): i for i, w in enumerate(self.words)}
        self.sets: list[frozenset[int]] = []
        self.ids: dict[frozenset[int], int] = {}
        self.moves: list[dict[int, int]] = []
        self.labels: list[list[str]] = []
        self.shares: list[float] = []
        self.start = self._id(self.automaton.closed([0]))
        self.first, self.pairs = self._entries()

    def _id(self, states: frozenset[int]) -> int:
        if not states:
            return -1
        found = self.ids.get(states)
        if found is None:
            found = self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.labels.append(sorted({self.automaton.label[s] for s in states} - {None}))
            self.shares.append(max(self.automaton.share[s] for s in states))
        return found

    def move(self, at: int, word: int) -> int:
        to = self.moves[at].get(word)
        if to is None:
            to = self.moves[at][word] = self._id(self.automaton.after(self.sets[at], self.words[word] if word >= 0 else None))
        return to

    def _entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Words after which anything may follow at the start of a match, and pairs that may begin one (as first * n + second)."""
        n = len(self.words)
        alone, pairs = np.zeros(n + 1, bool), []
        begins = self.sets[self.start]
        if any(self.automaton.by_any[s] is not None for s in begins):
            alone[:] = True
        for first in sorted({w for s in begins for w in self.automaton.by_word[s]}):
            a = self.words.index(first)
            behind = self.move(self.start, a)
            states = self.sets[behind]
            if self.labels[behind] or any(self.automaton.by_any[s] is not None for s in states):
                alone[a] = True
            pairs += [a * n + self.words.index(w) for w in {w for s in states for w in self.automaton.by_word[s]}]
        return alone, np.unique(np.array(pairs, np.int64))

    def entries(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places where a match may begin; ``ends`` is the end of each word's row."""
        n = len(self.words)
        begins = self.first[codes]
        if len(codes) > 1:
            a, b = codes[:-1], codes[1:]
            both = (a >= 0) & (b >= 0) & (np.arange(1, len(codes)) < ends[:-1])
            begins[:-1] |= both & np.isin(a * n + b, self.pairs)
        return np.flatnonzero(begins)

    def run(self, codes: np.ndarray, begin: int, end: int) -> tuple[dict[str, int], float]:
        """Matches that begin at ``begin``, the longest of each label, and the greatest share that was gone through."""
        at, found, share, length = self.start, {}, 0.0, 0
        for piece in range(begin, end, 32):
            for word in codes[piece : min(piece + 32, end)].tolist():
                at = self.move(at, word)
                if at < 0:
                    return found, share
                length += 1
                share = max(share, self.shares[at])
                for label in self.labels[at]:
                    found[label] = length
        return found, share

    def phrase_places(self, codes: np.ndarray, ends: np.ndarray) -> list[tuple[str, int, np.ndarray]]:
        """(label, length, starts) of each phrase."""
        out = []
        for label, phrase in self.phrases:
            n = len(phrase)
            stands = np.arange(len(codes)) + n <= ends
            for k, word in enumerate(phrase):
                number = self.number[word.encode()]
                stands[: len(codes) - k] &= codes[k:] == number
            out.append((label, n, np.flatnonzero(stands)))
        return out


def scan(docs: DataFrame, key: str = "doc_id", templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), phrases: Sequence[tuple[str, str]] = tuple(PHRASES)) -> DataFrame:
    """(key, text) -> (key, n_words, phrases, matches, score), one row per row.

    ``phrases`` holds (label, start, length) of every place of a phrase, ``matches`` the same of accepted templates;
    starts count words from 0.
    """
    small_batches(docs)
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    matcher = Matcher(templates, phrases)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = split_words(batch.column("text"), MARKS, LOWER)
            number = np.array([matcher.number.get(w, NO_WORD) for w in words.names.to_pylist()], np.int64)
            codes = number[words.codes] if len(words.codes) else np.empty(0, np.int64)
            row, bounds = words.rows, words.bounds
            ends = bounds[1:][row]
            plain: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            matches: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            score = np.zeros(batch.num_rows)
            for label, length, places in matcher.phrase_places(codes, ends):
                for i in places.tolist():
                    plain[row[i]].append((label, i - int(bounds[row[i]]), length))
            for i in matcher.entries(codes, ends).tolist():
                r = int(row[i])
                found, share = matcher.run(codes, i, int(ends[i]))
                score[r] = max(score[r], share)
                matches[r] += [(label, i - int(bounds[r]), n) for label, n in sorted(found.items())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(np.diff(bounds), pa.int64()), pa.array(plain, kind), pa.array(matches, kind), pa.array(score)],
                names=[key, "n_words", "phrases", "matches", "score"],
            )

    spans = "array<struct<label:string,start:long,length:long>>"
    return docs.select(key, "text").mapInArrow(rows, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, phrases {spans}, matches {spans}, score double")
