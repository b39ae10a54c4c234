"""Share of repeated content within a value, and values whose generation broke.

A logistic regression over hashed word and character n-grams, each crossed with whether it
has occurred before in the value, is trained on a bounded sample labelled by the exact
share, calibrated on held-out rows of that sample, and scores all values in Arrow batches
against fixed thresholds. Values below the lower threshold are sound and done with; the
exact share of those above it is computed, and settles them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.datasets import hash_sample

#: The tags set aside as spaces.
TAGS = re.compile(r"<(?:nl|fcel|ecel|lcel|ucel|xcel)>")
WORDS = re.compile(r"[^\W_]+")
#: Words that must recur in order, and the share of repeated words of a broken value.
RUN, BROKEN = 6, 0.4
#: Orders of the word and character n-grams.
WORD_ORDERS, CHAR_ORDERS = (1, 2, 4, 6), (6, 16)
#: Hashed features; the last of them hold each order's first and repeated n-grams, whatever they are.
CELLS = 1 << 10
#: Rows with the smallest hashes of their keys that the regression is fitted on.
SAMPLE_ROWS = 3000
#: Broken values of the sample from which on the regression is trusted; with fewer every value is let through.
FEWEST_BROKEN = 20
#: A value at or above this probability is let through to the exact share.
LET_THROUGH = 0.005
#: A value at or above this probability is called broken without the exact share (column `likely`).
LIKELY = 0.5

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _crc(words: list[str]) -> np.ndarray:
    from zlib import crc32

    codes = {w: crc32(w.encode("utf-8", "surrogatepass")) for w in set(words)}
    return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


def _grams(code: np.ndarray, row: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, row, hash) of the n-grams that lie within one row."""
    ends = np.cumsum(sizes)
    place = np.flatnonzero(np.arange(len(code)) + n <= ends[row])
    sig = np.zeros(len(place), np.uint64)
    for k in range(n):
        sig = _mix(sig * _MULT + code[place + k] + np.uint64(1))
    return place, row[place], sig


def _again(row: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Whether an equal n-gram lies earlier in the same row."""
    key = _mix(sig + row.astype(np.uint64) * _MULT)
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    return later


class Batch:
    """Words of a batch of values, tags set aside."""

    def __init__(self, values: list[str | None]):
        self.texts = [TAGS.sub(" ", v).lower() if v else "" for v in values]
        lists = [WORDS.findall(t) for t in self.texts]
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.row = np.repeat(np.arange(len(lists)), self.sizes)
        self.code = _mix(_crc([w for ws in lists for w in ws]) * _MULT)

    def shares(self) -> np.ndarray:
        """Share of words that belong to RUN consecutive words seen before; 0 without words."""
        place, row, sig = _grams(self.code, self.row, self.sizes, RUN)
        start = place[_again(row, sig)]
        mark = np.zeros(len(self.code) + 1, np.int64)
        np.add.at(mark, start, 1)
        np.add.at(mark, start + RUN, -1)
        repeated = np.bincount(self.row, weights=np.cumsum(mark[:-1]) > 0, minlength=len(self.sizes))
        return repeated / np.maximum(self.sizes, 1)

    def features(self) -> np.ndarray:
        """(rows, CELLS) shares of the hashed n-grams of each order, first and repeated ones apart."""
        rows = len(self.sizes)
        out = np.zeros(rows * CELLS)
        chars = [t.encode("utf-16-le", "surrogatepass") for t in self.texts]
        csize = np.fromiter((len(c) // 2 for c in chars), np.int64, len(chars))
        crow = np.repeat(np.arange(len(chars)), csize)
        ccode = np.frombuffer(b"".join(chars), np.uint16).astype(np.uint64)
        plain = 2 * (len(WORD_ORDERS) + len(CHAR_ORDERS))
        order = 0
        for code, row, sizes, orders in ((self.code, self.row, self.sizes, WORD_ORDERS), (ccode, crow, csize, CHAR_ORDERS)):
            for n in orders:
                _, r, sig = _grams(code, row, sizes, n)
                seen = _again(r, sig)
                name = sig * np.uint64(64) + np.uint64(2 * order) + seen.astype(np.uint64)
                cell = (_mix(name * _MULT) % np.uint64(CELLS - plain)).astype(np.int64)
                weight = (1.0 / np.maximum(np.bincount(r, minlength=rows), 1))[r]
                out += np.bincount(r * CELLS + cell, weights=weight, minlength=rows * CELLS)
                out += np.bincount(r * CELLS + CELLS - plain + 2 * order + seen, weights=weight, minlength=rows * CELLS)
                order += 1
        return out.reshape(rows, CELLS)


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps, each solved by conjugate gradients; the last weight is the intercept."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad, curve = a.T @ (p - y) + ridge * w, p * (1 - p)
        step, left = np.zeros_like(w), grad.copy()
        way, norm = left.copy(), float(left @ left)
        for _ in range(100):
            if norm < 1e-10:
                break
            along = a.T @ (curve * (a @ way)) + ridge * way
            size = norm / float(way @ along)
            step += size * way
            left -= size * along
            norm, before = float(left @ left), norm
            way = left + (norm / before) * way
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of weights and the two numbers of the calibration, from the labelled sample."""
    values = [v for b in batches for v in b.column("value").to_pylist()]
    weights, scale, shift = np.zeros(CELLS + 1), 1.0, 0.0
    if values:
        parts = [Batch(values[i : i + 256]) for i in range(0, len(values), 256)]
        y = np.concatenate([b.shares() >= BROKEN for b in parts]).astype(np.float64)
        if y.sum() >= FEWEST_BROKEN:
            x = np.concatenate([b.features() for b in parts])
            held = np.zeros(len(y), bool)  # a quarter of the broken and of the sound
            for kind in (0, 1):
                held[np.flatnonzero(y == kind)[3::4]] = True
            weights = _fit(x[~held], y[~held])
            scale, shift = _calibrate(x[held] @ weights[:-1] + weights[-1], y[held])
    yield pa.record_batch([pa.array([weights.tolist()]), pa.array([float(scale)]), pa.array([float(shift)])], names=["weights", "scale", "shift"])


def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the score so that its logistic is a probability (smoothed labels)."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    s = score / max(1.0, np.abs(score).max())
    a, c = np.stack([s, np.ones_like(s)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        c -= np.linalg.solve(hess, a.T @ (p - target) + 1e-3 * c)
    return c[0] / max(1.0, np.abs(score).max()), c[1]


def _score(model: dict, batches: Iterator[pa.RecordBatch], only_found: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("value").to_pylist()
        words, shares, probs = [], [], []
        for i in range(0, len(values), 256):
            b = Batch(values[i : i + 256])
            score = b.features() @ model["weights"][:-1] + model["weights"][-1]
            prob = 1 / (1 + np.exp(-np.clip(model["scale"] * score + model["shift"], -30, 30)))
            words.append(b.sizes)
            probs.append(prob)
            let = np.flatnonzero(prob >= LET_THROUGH)
            share = np.full(len(prob), np.nan)
            share[let] = Batch([values[i + k] for k in let.tolist()]).shares()
            shares.append(share)
        n, share, prob = (np.concatenate(x) if x else np.zeros(0) for x in (words, shares, probs))
        broken = pa.array(np.nan_to_num(share) >= BROKEN)
        out = pa.record_batch(
            [batch.column("id"), pa.array(n.astype(np.int64)), pa.array(share, from_pandas=True), pa.array(prob.astype(np.float64)), pa.array(prob >= LIKELY), broken],
            names=["id", "n_words", "share", "probability", "likely", "broken"],
        )
        yield out.filter(broken) if only_found else out


def repetition(df: DataFrame, key: str = "record_id", value: str = "otsl", only_found: bool = False, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, n_words, share, probability, likely, broken), one row for each key.

    `probability` comes from the regression. `share` is the exact share of the values it lets
    through (null for the others, which are sound); `broken` holds where that is at least
    0.4. Null, empty and wordless values aren't broken. A key that comes again counts once,
    by its row of the largest probability. With fewer than FEWEST_BROKEN broken values in the
    sample every value is let through. An empty table gives no rows; other columns are
    ignored. only_found: only the broken ones.
    """
    rows = df.select(F.col(key).alias("id"), F.col(value).alias("value"))
    # Rows of a key that comes again may be in the sample twice; only the fit sees them.
    sample = hash_sample(rows.where("value is not null").select("value", F.xxhash64("id").alias("h")), "h", sample_rows)
    fitted = sample.coalesce(1).select("value").mapInArrow(_train, "weights array<double>, scale double, shift double").first()
    model = {"weights": np.zeros(CELLS + 1), "scale": 1.0, "shift": 0.0} if fitted is None else {"weights": np.array(fitted["weights"]), "scale": fitted["scale"], "shift": fitted["shift"]}
    schema = f"id {dict(rows.dtypes)['id']}, n_words bigint, share double, probability double, likely boolean, broken boolean"
    scored = rows.mapInArrow(partial(lambda m, it: _score(m, it, only_found), model), schema)
    return scored.groupBy("id").agg(F.max(F.struct("probability", "broken", "share", "n_words", "likely")).alias("s")).select("id", *[f"s.{c}" for c in ("n_words", "share", "probability", "likely", "broken")])


def repeated_shares(df: DataFrame, key: str = "record_id", value: str = "otsl") -> DataFrame:
    """(id, n_words, share, broken): the exact share of every value, one row for each key.

    Null, empty and wordless values have share 0. A key that comes again counts once, by its
    row of the largest share; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("id"), F.col(value).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("value").to_pylist()
            parts = [Batch(values[i : i + 256]) for i in range(0, len(values), 256)]
            n, share = (np.concatenate(x) if x else np.zeros(0) for x in ([b.sizes for b in parts], [b.shares() for b in parts]))
            yield pa.record_batch([batch.column("id"), pa.array(n.astype(np.int64)), pa.array(share)], names=["id", "n_words", "share"])

    best = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_words bigint, share double").groupBy("id").agg(F.max(F.struct("share", "n_words")).alias("s"))
    return best.select("id", "s.n_words", "s.share", (F.col("s.share") >= BROKEN).alias("broken"))
