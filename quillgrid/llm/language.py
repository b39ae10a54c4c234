"""Languages of short texts, by profiles of character n-grams fitted on labelled documents.

A profile holds, for each language, the log-probabilities of hashed n-grams of one to four
characters within words, and its most frequent words. It is fitted on a bounded sample of
the labelled rows. Scripts other than Latin tell the language by themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.datasets import hash_sample

#: Labelled rows that a profile is fitted on, those of the smallest hashes of their keys.
SAMPLE_ROWS = 3000
#: Rows that a language needs among them.
FEWEST_ROWS = 15
#: Hashed n-grams, and their orders.
CELLS, ORDERS = 1 << 13, (1, 2, 3, 4)
#: Words whose scores a worker keeps; results don't depend on it.
KEPT_WORDS = 200_000
#: Frequent words kept of each language.
FREQUENT = 60
#: Words of a line of prose at least.
PROSE_WORDS = 6

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_LETTER = re.compile(r"[^\W\d_]")
_TAGS = re.compile(r"<[^<>]*>|```.*?(?:```|$)", re.S)
_MEASURE = re.compile(r"\d\S*\s+[^\W\d_]{1,4}\b")
_BREAK = re.compile(r"(?<=[.!?。！？])\s*|\n+")


def cells_of(word: str) -> list[int]:
    """Hashed n-grams of a word in its bounds."""
    w = f" {word} "
    return [crc32(f"{n}{w[i : i + n]}".encode("utf-8", "surrogatepass")) % CELLS for n in ORDERS for i in range(len(w) - n + 1)]


def prose(text: str) -> Iterator[list[str]]:
    """Words of the lines and sentences of a text that are prose: mostly lower-case words, no markup, few numbers; units aside."""
    for line in _BREAK.split(_TAGS.sub("\n", text)):
        words = _WORD.findall(_MEASURE.sub(" ", line))
        if len(words) >= PROSE_WORDS and sum(w.islower() for w in words) >= 0.5 * len(words) and not re.search(r"[{}=<>|\\]|\d.*\d.*\d.*\d.*\d", line):
            yield [w.lower() for w in words]


@dataclass
class Profile:
    """Fitted languages: their names, log-probabilities (languages, CELLS), each one's own frequent words, and those of all."""

    names: list[str]
    weights: np.ndarray
    frequent: dict[str, frozenset[str]]
    common: frozenset[str] = frozenset()

    def __post_init__(self):
        # What a language's n-gram says beyond the mean of all: unknown n-grams say nothing.
        self.delta = self.weights - self.weights.mean(axis=0) if self.names else self.weights
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, max(1, len(self.names))))

    def _add(self, word: str) -> int:
        if len(self.ids) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        k = self.ids[word] = len(self.ids)
        self.rows[k] = self.delta[:, cells_of(word)].mean(axis=1) * min(len(word) + 1, 8) + [4.0 * (word in self.frequent[n]) for n in self.names]
        return k

    def score(self, words: set[str]) -> np.ndarray:
        """Support of each language by distinct words; one of its frequent words counts more."""
        if len(self.ids) + len(words) > KEPT_WORDS:
            self.ids.clear()
        get = self.ids.get
        ids = [k if (k := get(w)) is not None else self._add(w) for w in words]
        return self.rows[ids].sum(axis=0)

    def of(self, text: str, lead: float = 3.0, least: int = 1) -> str | None:
        """The language of a text, or the name of a script other than Latin; None where fewer than `least`
        words, or no language by the lead, tell."""
        if not text.isascii():
            letters = _LETTER.findall(text)
            other = [c for c in letters if not _LATIN.match(c)]
            if len(other) >= 4 and 2 * len(other) > len(letters) - len(other):
                return script_of(Counter(other).most_common(1)[0][0])
        found = _WORD.findall(text)
        # A capital within a sentence begins a name more often than not, and names tell no language.
        words = {w.lower().replace("’", "'") for k, w in enumerate(found) if k == 0 or not w[0].isupper()}
        if len(words) < max(1, least) or not self.names:
            return None
        s = self.score(words)
        if len(s) == 1:
            return self.names[0] if s[0] >= lead else None
        best = int(s.argmax())
        first = s[best]
        s[best] = -np.inf
        return self.names[best] if first - s.max() >= lead else None


def script_of(char: str) -> str:
    """'CJK', 'CYRILLIC', ...: the first word of a character's name; one name for the scripts of Chinese and Japanese."""
    name = unicodedata.name(char, "UNKNOWN").split()[0]
    return "CJK" if name in ("CJK", "HIRAGANA", "KATAKANA") else name


def fit(labelled: list[tuple[str, str]]) -> Profile:
    """The profile of (language, text) rows; labels are compared in lower case without blanks."""
    lines: dict[str, list[list[str]]] = {}
    rows: Counter = Counter()
    for lang, text in labelled:
        name = lang.strip().lower()
        rows[name] += 1
        lines.setdefault(name, []).extend(prose(text))
    names = sorted(n for n in lines if rows[n] >= FEWEST_ROWS and lines[n])
    weights, frequent = np.zeros((len(names), CELLS)), {}
    for k, n in enumerate(names):
        # The same sentence in many rows, and the same word in many, count by the root of their number.
        words = Counter(w for line in {tuple(x) for x in lines[n]} for w in set(line))
        for w, m in sorted(words.items()):
            np.add.at(weights[k], cells_of(w), m**0.5)
        frequent[n] = sorted((w for w in words if len(w) <= 8), key=lambda w: (-words[w], w))[:FREQUENT]
    top = {n: set(frequent[n]) for n in names}
    weights = np.log((weights + 0.5) / (weights.sum(axis=1, keepdims=True) + 0.5 * CELLS)) if names else weights
    # A word that is frequent in several languages tells none of them apart, but it is no name.
    alone = {n: frozenset(w for w in top[n] if sum(w in top[m] for m in names) == 1) for n in names}
    return Profile(names, weights.astype(np.float32), alone, frozenset(w for n in names for w in top[n]))


def fit_languages(df: DataFrame, key: str, text: str, lang: str, sample_rows: int = SAMPLE_ROWS) -> Profile:
    """The profile of the languages of `df`'s column `lang`, from a bounded sample of the rows that have a label.

    Null labels and texts take no part; a language of fewer than FEWEST_ROWS rows in the
    sample isn't known. An empty table gives a profile that knows only scripts.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.trim(lang) != ""))
    sample = hash_sample(rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h")), "h", sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelled = [x for b in batches for x in zip(b.column("lang").to_pylist(), b.column("text").to_pylist())]
        p = fit(labelled)
        yield pa.record_batch(
            [pa.array([p.names], pa.list_(pa.string())), pa.array([p.weights.ravel().tolist()], pa.list_(pa.float32())), pa.array([[sorted(p.frequent[n]) for n in p.names]], pa.list_(pa.list_(pa.string()))), pa.array([sorted(p.common)], pa.list_(pa.string()))],
            names=["names", "weights", "frequent", "common"],
        )

    got = sample.coalesce(1).select("lang", "text").mapInArrow(run, "names array<string>, weights array<float>, frequent array<array<string>>, common array<string>").first()
    if got is None:
        return Profile([], np.zeros((0, CELLS), np.float32), {})
    names = list(got["names"])
    return Profile(names, np.array(got["weights"], np.float32).reshape(len(names), CELLS), {n: frozenset(f) for n, f in zip(names, got["frequent"])}, frozenset(got["common"]))
