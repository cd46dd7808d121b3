"""Quality rules as a short-circuit cascade.

Rules are predicates over a document's statistics; a document that fails one is rejected. What a rule costs and how often it
rejects is measured on a sample, and the rules are ordered by rejections per cost, so that most rejected documents meet only cheap
rules. The verdict doesn't depend on the order. Statistics that only some rules need are made when one asks for them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_NO_LETTER = bytes(sorted({*range(128)} - {*_LETTERS}))
WINDOW = 3
SAMPLE_DOCS = 2000


class Document:
    """Statistics of a text. Words are runs of anything but ASCII white space; lines end at \\n and count if they have a word."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.bytes = self.text.encode()
        self.words = self.bytes.split()
        self.n_words = len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.bytes.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len({*self.lines})

    @cached_property
    def _ids(self) -> tuple[np.ndarray, list[bytes]]:
        """The words as numbers, and the different words."""
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in self.words], np.int64)
        return ids, list(seen)

    @cached_property
    def counts(self) -> np.ndarray:
        ids, words = self._ids
        return np.bincount(ids, minlength=len(words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three that are found twice or more."""
        if self.n_words <= WINDOW:
            return 0
        ids, words = self._ids
        n, key = len(words), ids[: 1 - WINDOW]
        for k in range(1, WINDOW):
            if n > 2_000_000:  # stay below 64 bits
                key = np.unique(key, return_inverse=True)[1]
            key = key * n + ids[k : len(ids) - WINDOW + 1 + k]
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        covered = np.zeros(self.n_words, bool)
        at = np.flatnonzero(times[where] > 1)
        for k in range(WINDOW):
            covered[at + k] = True
        return int(covered.sum())

    @cached_property
    def n_upper(self) -> int:
        return len(self.bytes) - len(self.bytes.translate(None, _UPPER))

    @cached_property
    def n_letters(self) -> int:
        return len(self.bytes) - len(self.bytes.translate(None, _LETTERS))

    @cached_property
    def n_wordlike(self) -> int:
        """Words with a letter; all characters beyond ASCII count as letters."""
        return int(sum(c for w, c in zip(self._ids[1], self.counts.tolist(), strict=True) if w.translate(None, _NO_LETTER)))

    @cached_property
    def top_word(self) -> int:
        return int(self.counts.max(initial=0))

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


#: A rule says that a document fails.
RULES: dict[str, Callable[[Document], bool]] = {
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "shouting": lambda d: 5 * d.n_upper > 2 * d.n_letters,
    "repeated_lines": lambda d: 2 * d.n_dup_lines > len(d.lines),
    "word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 25 * d.n_words,
    "one_word": lambda d: 10 * d.top_word > 3 * d.n_words,
    "no_words": lambda d: 10 * d.n_wordlike < 7 * d.n_words,
}


def order_rules(documents: DataFrame, rules: dict[str, Callable[[Document], bool]] = RULES, sample: int = SAMPLE_DOCS) -> list[str]:
    """Names of rules by rejections per second on about ``sample`` documents, chosen by a hash of their ids and measured where they
    lie. Rules that reject nothing there come last, cheapest first."""
    import pyarrow as pa

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, seen = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for batch in batches:
            for x in batch.column(0):
                for name, fails in rules.items():
                    d = Document(x.as_py())  # what a rule shares with an earlier one counts for each
                    began = time.perf_counter()
                    hits[name] += fails(d)
                    spent[name] += time.perf_counter() - began
                seen += 1
        names = list(rules) if seen else []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([spent[n] for n in names], pa.float64()), pa.array([hits[n] for n in names], pa.int64())], names=["rule", "spent", "hits"])

    every = max(1, documents.count() // sample)
    some = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    found = {r.rule: r for r in some.mapInArrow(measure, "rule string, spent double, hits long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("hits").alias("hits")).collect()}
    value = lambda n: (-found[n].hits / max(found[n].spent, 1e-9), found[n].spent) if n in found else (0.0, 0.0)
    return sorted(rules, key=value)


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def apply_rules(documents: DataFrame, order: list[str] | None = None, rules: dict[str, Callable[[Document], bool]] = RULES) -> DataFrame:
    """Statistics and verdict of each document: it is kept if it passes the base rule and then all others, in ``order``.

    documents: doc_id, text; more columns are ignored. A null or empty text has no words and fails the base rule; a null doc_id and
    repeated rows get a row each. An empty table gives none.
    """
    import pyarrow as pa

    names = order_rules(documents, rules) if order is None else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fails = [rules[n] for n in names]
        for batch in batches:
            rows = []
            for x in batch.column(1):
                d = Document(x.as_py())
                base = d.base_failed
                rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, base, not base and not any(f(d) for f in fails)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[f.split()[0] for f in RESULT.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)
