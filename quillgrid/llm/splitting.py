"""Texts above a token limit in overlapping pieces, cut where the text pauses.

Every text is encoded once; places between its tokens are graded by what the text does
there (paragraph, line, sentence, clause, word, within a word). Dynamic programming over
all places finds the cuts of least penalty and imbalance under the limit, many texts at a
time. Pieces are counted again on their own; the rare text in which one exceeds the limit is
cut anew with as many tokens less.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PRETOKEN_PATTERN, TOKENIZER_DIR
from .encode import chunks

#: Penalties of a cut: after a paragraph, a line, a sentence, a clause, a word, elsewhere; of a piece; of imbalance.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 0.0, 0.15, 0.4, 1.0, 2.0, 12.0
PIECE, IMBALANCE = 1.0, 1.5
#: Texts that are worked through together, and cells of their common table at most.
LANES, LANE_CELLS = 64, 1 << 20
#: Strides of a piece's size in the program over all places.
STRIDES = 4
LONGEST_STRIDE = 32
#: Cells of a stride's table, about.
TABLE = 1 << 17
#: Bytes of parts of texts up to which their counts are kept, as many come again.
SHORT = 64
#: Tokens of the texts whose places are graded together, about.
TOGETHER = 1 << 16
#: Characters of the texts that are encoded and cut together.
CHUNK_CHARS = 1 << 22
#: Blocks of a piece's room in the program that bounds the cost of a place.
BLOCKS = 8
#: Rough places of a block in the search for a cost that can be had.
ROUGH = 1
#: Pieces up to which the bounds are tried; the result doesn't depend on it.
BOUNDED = 20


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """(encode, tokens of a part of a text in UTF-8, byte length of each id) of a byte-level vocabulary."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for raw, k in ranks.items():
        size[k] = len(raw)
    encode = tiktoken.Encoding(name, pat_str=PRETOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    count = lambda part: len(encode(part.decode("utf-8")))
    short = lru_cache(maxsize=1 << 16)(count)
    return encode, lambda part: short(part) if len(part) <= SHORT else count(part), size


def _among(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def _pairs() -> np.ndarray:
    """Penalty of a cut between any two bytes, as far as these tell; inf within a character."""
    before, after = np.arange(256)[:, None], np.arange(256)[None]
    space = _among(b" \t\r\n\x00")[after]
    out = np.full((256, 256), INSIDE)
    out[space | _among(b" \t")[before]] = WORD
    out[space & _among(b",;:)")[before]] = CLAUSE
    out[space & _among(b".!?")[before]] = SENTENCE
    out[(before == 10) & (after != 10) & (after != 13)] = LINE
    out[np.broadcast_to((after & 0xC0) == 0x80, out.shape)] = np.inf
    return out.ravel()


_PAIRS = _pairs()


def grades(pad: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Penalty of a cut before each of the places `at` of the bytes, three bytes in at least; inf within a character."""
    p1, n1 = pad[at - 1], pad[at]
    out = _PAIRS[p1.astype(np.int64) << 8 | n1]
    line = np.flatnonzero(p1 == 10)
    line = line[out[line] == LINE]
    p2 = pad[at[line] - 2]
    out[line[(p2 == 10) | ((p2 == 13) & (pad[at[line] - 3] == 10))]] = PARAGRAPH
    wide = np.flatnonzero(pad[at - 3] >= 0xE3)  # scripts written without spaces pause anywhere between characters
    if len(wide):
        g = out[wide]
        g[(g == INSIDE) & (n1[wide] >= 0xE3)] = WORD + 1
        three = (pad[at[wide] - 3].astype(np.int32) << 16) | (pad[at[wide] - 2].astype(np.int32) << 8) | p1[wide]
        whole = np.isfinite(g)
        g[whole & ((three == 0xEFBC8C) | (three == 0xEFBC9B) | (three == 0xEFBC9A) | (three == 0xE38081))] = CLAUSE
        g[whole & ((three == 0xE38082) | (three == 0xEFBC81) | (three == 0xEFBC9F))] = SENTENCE
        out[wide] = g
    return out


class Task(NamedTuple):
    """The cutting of one text: penalties of its places, the nearest place at or before each token
    that isn't within a character, and what a piece may hold."""

    grade: np.ndarray
    before: np.ndarray
    room: int
    overlap: int


def before_of(grade: np.ndarray) -> np.ndarray:
    place, whole = np.arange(len(grade)), np.isfinite(grade)
    return place if whole.all() else np.maximum.accumulate(np.where(whole, place, 0))


class Steps(NamedTuple):
    """The places of a task that are let in: where they lie, where a piece after each begins, their
    fees, the first place from which a piece may reach each, and the sizes that pieces should have."""

    end: np.ndarray
    begin: np.ndarray
    fee: np.ndarray
    low: np.ndarray
    ideal: float
    scale: float


def least_pieces(task: Task) -> int:
    return max(1, -(-(len(task.grade) - 1 - task.overlap) // (task.room - task.overlap)))


def size_of(task: Task) -> tuple[float, float]:
    """(tokens that the pieces should have, weight of a squared difference from it)."""
    n, count = len(task.grade) - 1, least_pieces(task)
    tokens = n + (count - 1) * task.overlap
    return tokens / count, IMBALANCE * (count / tokens) ** 2


def steps_of(task: Task, keep: np.ndarray) -> Steps:
    """The places of the mask `keep`, and both ends of the text."""
    n = len(task.grade) - 1
    keep[0] = keep[n] = True
    end = np.flatnonzero(keep)
    # A piece begins `overlap` tokens before its cut, or before the character these would begin in.
    begin = task.before[np.maximum(end - task.overlap, 0)]
    fee = task.grade[end] + PIECE
    fee[-1] = PIECE
    return Steps(end, begin, fee, np.searchsorted(begin, end - task.room), *size_of(task))


def bounds(tasks: list[Task], block: int) -> list[np.ndarray]:
    """For every place of each text, a cost below which no pieces with a cut there can be.

    The program over blocks of places: a block has the least penalty of its places, and a
    piece from one block to another the least imbalance that any two of their places allow.
    """
    lanes = len(tasks)
    n = np.array([len(t.grade) - 1 for t in tasks])
    rows = int(n.max()) // block + 1
    ideal, scale = np.array([size_of(t) for t in tasks]).T
    room, overlap = (np.array([getattr(t, f) for t in tasks]) for f in ("room", "overlap"))

    def piece(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The least imbalance of a piece of `least` to `most` tokens; inf above the room."""
        off = np.maximum(np.maximum(least - ideal, ideal - np.minimum(most, room)), 0)
        return np.where(least <= room, scale * off**2, np.inf)

    fee = np.full((rows, lanes), np.inf)
    for t, x in enumerate(tasks):
        g = x.grade.copy()
        g[0] = g[-1] = np.inf
        m = int(n[t]) // block + 1
        fee[:m, t] = np.minimum.reduceat(g, np.arange(m) * block) + PIECE
    at = np.arange(rows)[:, None] * block
    reach = int(((room - overlap + block - 1) // block).max())
    apart = np.arange(reach, 0, -1)[:, None] * block
    step = piece(np.maximum(apart - block + 1, 0) + overlap, apart + block + 2 + overlap)  # up to three tokens more, within a character
    front, back = piece(at, at + block - 1), piece(np.maximum(n - at - block + 1, 0) + overlap, n - at + overlap + 3)
    ahead, behind = front + fee, back + fee
    for k in range(1, rows):
        w = min(k, reach)
        np.minimum(front[k], (ahead[k - w : k] + step[reach - w :]).min(axis=0), out=front[k])
        np.add(front[k], fee[k], out=ahead[k])
    turned = step[::-1]
    for k in range(rows - 2, -1, -1):
        w = min(rows - 1 - k, reach)
        np.minimum(back[k], (behind[k + 1 : k + 1 + w] + turned[:w]).min(axis=0), out=back[k])
        np.add(back[k], fee[k], out=behind[k])
    both = front + back + 2 * PIECE
    return [np.repeat(both[: n[t] // block + 1, t], block)[: n[t] + 1] + x.grade for t, x in enumerate(tasks)]


def outdone(task: Task) -> np.ndarray:
    """A mask of places that are in no best cutting, as two cuts at better places beside each do better, however the pieces lie.

    Of a place within a word let a be the last better place before it and b the next after it. Cuts
    at a and b in its stead only shorten the pieces on both sides, which so keep the room; a token
    less costs a piece 2 * scale * ideal at most. The piece from a to b is one more. Where a piece
    beside the place doesn't reach beyond a or b, one of the two cuts or none will do instead: what
    grows then lies within the piece from a to b, which has no more tokens than it should.
    """
    n = len(task.grade) - 1
    hard = task.grade >= INSIDE
    hard[0] = hard[n] = False
    k, soft = np.flatnonzero(hard), np.flatnonzero(~hard)
    at = np.searchsorted(soft, k)
    a, b = soft[at - 1], soft[at]
    begin_a, begin_k, begin_b = (task.before[np.maximum(x - task.overlap, 0)] for x in (a, k, b))
    ideal, scale = size_of(task)
    instead = task.grade[a] + task.grade[b] + PIECE + scale * (b - begin_a - ideal) ** 2 + 2 * scale * ideal * (k - a + begin_b - begin_k)
    out = np.zeros(n + 1, bool)
    out[k[(b - begin_a <= ideal) & (instead < task.grade[k] - 1e-9)]] = True
    return out


def best_of_each(grade: np.ndarray, block: int) -> np.ndarray:
    """A mask of the last of the best places of each block."""
    rows = -(-len(grade) // block)
    padded = np.full(rows * block, np.inf)
    padded[: len(grade)] = grade
    keep = np.zeros(rows * block, bool)
    keep[np.arange(rows) * block + block - 1 - np.argmin(padded.reshape(rows, block)[:, ::-1], axis=1)] = True
    return keep[: len(grade)] & np.isfinite(grade)


def cheapest(many: list[Steps], pieces: bool = True) -> list[tuple[float, list[tuple[int, int]]]]:
    """(cost, pieces) of each text, over all of its places; an infinite cost where no cuts keep the room; pieces if asked for.

    cost(k) = fee(k) + the least of cost(j) + scale * (end(k) - begin(j) - ideal)^2 over the
    places j in reach. All texts, a row each, go a stride of places on together: the square
    is opened up, so that all j before the stride are one product, one difference and one
    minimum. The j within the stride are looked at only where one of them is cheap enough to
    matter. The longest texts come first; those that are through are left out.
    """
    lanes, rows = len(many), max(len(x.end) for x in many)
    end, begin, low = np.zeros((lanes, rows)), np.zeros((lanes, rows)), np.full((lanes, rows), rows, np.int32)
    fee = np.full((lanes, rows), np.inf)
    for t, x in enumerate(many):
        n = len(x.end)
        end[t, :n], begin[t, :n], fee[t, :n], low[t, :n] = x.end, x.begin, x.fee, np.minimum(x.low, np.arange(n))
    ideal, scale = np.array([[x.ideal] for x in many]), np.array([[x.scale] for x in many])
    lowest = low.min(axis=0).tolist()
    for t, x in enumerate(many):  # a text that ends within a stride keeps its reach up to the stride's end
        low[t, len(x.end) :] = low[t, len(x.end) - 1]
    highest = low.max(axis=0).tolist()
    slope, own, known = 2 * scale * (end - ideal), scale * (end - ideal) ** 2 + fee, scale * begin**2  # cost(j) + scale * begin(j)^2
    cost = np.full((lanes, rows), np.inf)
    cost[:, 0] = 0.0
    there = np.searchsorted(-np.array([len(x.end) for x in many]), -np.arange(rows), "left").tolist()
    # Strides by the places in a piece of the texts that still go on; a stride's table should stay in the cache.
    most = np.minimum.accumulate([x.ideal * len(x.end) / (STRIDES * max(int(x.end[-1]), 1)) for x in many])
    wide = TABLE // max(1, max(k - j for k, j in enumerate(lowest)))
    strides = [int(max(1, min(LONGEST_STRIDE, a, wide // (t + 1)))) for t, a in enumerate(most)]
    work, last = np.empty(0), 1
    while last < rows:
        k, m = last, there[last]
        last = min(k + strides[m - 1], rows)
        c, j = cost[:m, k:last], min(lowest[k], k)
        if j < k:
            size = (last - k) * (k - j) * m
            work = work if len(work) >= size else np.empty(2 * size)
            w = work[:size].reshape(m, last - k, k - j)
            np.multiply(begin[:m, None, j:k], slope[:m, k:last, None], out=w)
            np.subtract(known[:m, None, j:k], w, out=w)
            top = min(highest[last - 1], k)
            if top > j:
                np.copyto(w[:, :, : top - j], np.inf, where=np.arange(j, top, dtype=np.int32) < low[:m, k:last, None])
            np.minimum.reduce(w, axis=2, out=c)
            c += own[:m, k:last]
        if last - k > 1:
            short = np.maximum(ideal[:m] - end[:m, k:last].max(axis=1, keepdims=True) + begin[:m, k, None], 0)  # by so much at least, from a place within the stride
            some = np.flatnonzero((np.minimum.accumulate(c[:, :-1], axis=1) + scale[:m] * short**2 + fee[:m, k + 1 : last] < c[:, 1:]).any(axis=1))
            for i in range(k + 1, last) if len(some) else ():
                d = cost[some, k:i] + scale[some] * (end[some, i, None] - begin[some, k:i] - ideal[some]) ** 2
                d[np.arange(k, i) < low[some, i, None]] = np.inf
                cost[some, i] = np.minimum(cost[some, i], d.min(axis=1) + fee[some, i])
        known[:m, k:last] += c
    out = []
    for t, x in enumerate(many):
        k, cuts = len(x.end) - 1, []
        total = float(cost[t, k])
        while pieces and k and total < np.inf:
            j = min(int(low[t, k]), k - 1)
            j += int((known[t, j:k] - slope[t, k] * begin[t, j:k]).argmin())
            cuts.append((int(x.begin[j]), int(x.end[k])))
            k = j
        out.append((total, cuts[::-1]))
    return out


def together(sizes: list[int], kinds: list[int]) -> Iterator[list[int]]:
    """Indexes of texts of one kind and of about the same size, the largest first, as many as may be worked through together."""
    order = sorted(range(len(sizes)), key=lambda i: (kinds[i], sizes[i]))
    while order:
        lanes = min(LANES, max(1, LANE_CELLS // max(sizes[order[-1]], 1)))
        part = [i for i in order[-lanes:] if kinds[i] == kinds[order[-1]]]
        yield part[::-1]
        del order[-len(part) :]


def best_cuts(tasks: list[Task]) -> list[list[tuple[int, int]] | None]:
    """(first, end) tokens of the pieces of each text, of least cost over all of its places; None if no cuts keep the room.

    The best place of every few tokens first gives a cost that can be had. A place whose
    bound lies above it is in no best cutting; the program then goes over all the others. With
    many pieces the bounds are too loose to tell; the program goes over all places that better
    ones beside them don't outdo.
    """
    out: list[list[tuple[int, int]] | None] = [None] * len(tasks)
    block = [max(2, (t.room - t.overlap) // BLOCKS) for t in tasks]
    left = [np.isfinite(t.grade) for t in tasks]
    few = [i for i, t in enumerate(tasks) if least_pieces(t) <= BOUNDED]
    for i in set(range(len(tasks))).difference(few):
        left[i] &= ~outdone(tasks[i])
    kinds = [block[i] for i in few]
    rough = [steps_of(tasks[i], best_of_each(tasks[i].grade, max(2, block[i] // ROUGH))) for i in few]
    had = [np.inf] * len(few)
    for part in together([len(x.end) for x in rough], kinds):
        for k, (cost, _) in zip(part, cheapest([rough[k] for k in part], pieces=False)):
            had[k] = cost
    for part in together([len(tasks[i].grade) // block[i] for i in few], kinds):
        for k, least in zip(part, bounds([tasks[few[k]] for k in part], kinds[part[0]])):
            left[few[k]] &= least <= had[k] * (1 + 1e-9)
    fine = [steps_of(t, keep) for t, keep in zip(tasks, left)]
    for part in together([len(x.end) for x in fine], block):
        for i, (cost, pieces) in zip(part, cheapest([fine[i] for i in part])):
            out[i] = pieces if np.isfinite(cost) else None
    return out


class Text(NamedTuple):
    """An encoded text: its bytes, the byte offset of each token, penalties of the places, the safe places
    between its begin and its end, whether a piece may safely begin or end at each place, its nearest whole
    character, and the characters before each byte."""

    data: bytes
    at: np.ndarray
    grade: np.ndarray
    safe: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    before: np.ndarray
    char: np.ndarray


def safe_places(pad: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of the places `at` of the bytes: whether a token begins there with a single space between visible ASCII
    characters, so that a pre-token begins and another ends there in the text and in every piece of it; whether a piece
    may so begin there, or end there. A line's end before a visible character serves for a begin, a single one after a
    visible character for an end as well."""
    seen = (pad > 32) & (pad < 127)
    kind = np.zeros(len(pad), np.uint8)  # 1: such a space; 2: the begin of such a line, 4: after a visible character
    kind[1:-1] = (pad[1:-1] == 32) & seen[:-2] & seen[2:]
    line = np.flatnonzero((pad[1:-1] == 10) & seen[2:]) + 2
    kind[line] |= 2
    kind[line[seen[line - 2]]] |= 4
    here = kind[at]
    return (here & 1).view(bool), here > 0, (here & 5) > 0


def own_counts(count, text: Text, cuts: list[tuple[int, int]]) -> list[int]:
    """Tokens of the text's tokens a to b on their own, for each of the cuts: only what precedes the first
    and follows the last single space within words can differ, and is encoded again; nothing does where
    the piece begins or ends safely itself."""
    at, data, n, safe = text.at, text.data, len(text.at) - 1, text.safe
    begin, end = np.array(cuts).T
    first = np.where(text.begins[begin], begin, safe[1:][np.searchsorted(safe[1:], begin)])
    last = np.where(text.ends[end], end, safe[np.searchsorted(safe[:-1], end, "right") - 1])
    out = end - begin
    for k in np.flatnonzero((first > begin) | (last < end)):
        a, b, f, t = int(begin[k]), int(end[k]), int(first[k]), int(last[k])
        if f > t or f == n:
            out[k] = count(data[at[a] : at[b]])
        else:
            out[k] = t - f + (count(data[at[a] : at[f]]) if f > a else 0) + (count(data[at[t] : at[b]]) if t < b else 0)
    return out.tolist()


def encoded(texts: list[str | None], encode, sizes: np.ndarray, least: int) -> list[Text | None]:
    """The texts with their places; None for those that have no more than `least` tokens."""
    out: list[Text | None] = [None] * len(texts)
    sizes, gap = np.append(sizes, 3), [len(sizes)]  # the bytes between two texts stand for a token
    some, datas, ids, size = [], [], [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8") if text else b""
        if len(data) > least:  # a token has at least one byte
            mine = encode(text)
            if len(mine) > least:
                some.append((i, size, len(mine)))
                datas.append(data)
                ids.append(np.array(gap + mine, np.int64))
                size += 1 + len(mine)
        if some and (size >= TOGETHER or i + 1 == len(texts)):
            pad = np.frombuffer(b"\0\0\0".join([b"", *datas, b""]), np.uint8)
            places = np.cumsum(sizes[np.concatenate(ids)])
            grade = grades(pad, places)
            safe, begins, ends = safe_places(pad, places)
            for (j, f, n), data in zip(some, datas):
                own = slice(f, f + n + 1)
                at, g = places[own] - places[f], grade[own]
                begins[f] = ends[f + n] = True
                char = np.arange(len(data) + 1, dtype=np.int32) if len(data) == len(texts[j]) else np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, dtype=np.int32)])
                out[j] = Text(data, at, g, np.concatenate([[0], np.flatnonzero(safe[own]), [n]]), begins[own], ends[own], before_of(g), char)
            some, datas, ids, size = [], [], [], 0
    return out


def split_texts(texts: list[str], limits: list[tuple[str, int, int]], tokenizer: str, folder: str) -> Iterator[tuple]:
    """(index, limit_name, piece_no, n_pieces, start_char, end_char, overlap_chars, n_tokens, piece, reason) for every limit a text exceeds."""
    encode, count, sizes = encoding(tokenizer, folder)
    least = min(m for _, m, _ in limits)
    known = encoded(texts, encode, sizes, least)
    todo = [(i, name, limit, Task(t.grade, t.before, limit, overlap)) for i, t in enumerate(known) if t for name, limit, overlap in limits if len(t.grade) - 1 > limit]
    while todo:
        again = []
        for (i, name, limit, task), cuts in zip(todo, best_cuts([x[3] for x in todo])):
            text = known[i]
            data, at, char = text.data, text.at, text.char
            if cuts is None:
                yield i, name, None, 0, 0, int(char[-1]), 0, len(at) - 1, None, "no cuts keep the limit"
                continue
            counts = own_counts(count, text, cuts)
            if max(counts) > limit:
                room = task.room - (max(counts) - limit)
                if room <= task.overlap:
                    yield i, name, None, 0, 0, int(char[-1]), 0, len(at) - 1, None, "no cuts keep the limit"
                else:
                    again.append((i, name, limit, task._replace(room=room)))
                continue
            spans = at[np.array(cuts)]
            end = 0
            for k, ((a, b), (s, e), c) in enumerate(zip(spans.tolist(), char[spans].tolist(), counts)):
                yield i, name, k, len(cuts), s, e, max(0, end - s), c, data[a:b].decode("utf-8"), None
                end = e
        todo = again


def split_oversized(df: DataFrame, key: str, text: str, limits: list[tuple[str, int, int]], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, limit_name, piece_no, n_pieces, start_char, end_char, overlap_chars, n_tokens, piece, reason).

    One row for each piece of every text with more tokens than a limit (name, max_tokens,
    overlap_tokens). Pieces keep the limit, counted on their own; without their overlap they
    give the text back; a piece repeats the last `overlap_tokens` tokens of the one before
    (up to three more where these would begin within a character). A text that no cuts bring
    under the limit (a character of more tokens than a piece may add) has one row without a
    piece: its length in tokens and the reason, which is null elsewhere. Null, empty and
    shorter texts give no rows, an empty table none; rows that come again are split again.
    """
    for name, most, overlap in limits:
        if not 0 <= overlap < most:
            raise ValueError(f"{name}: the overlap must be below the limit")
    rows = df.select(F.col(key).alias(key), F.col(text).alias("__text")).where(F.octet_length("__text") > min(m for _, m, _ in limits))
    names = ["limit_name", "piece_no", "n_pieces", "start_char", "end_char", "overlap_chars", "n_tokens", "piece", "reason"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.RecordBatch, got: list[tuple]) -> pa.RecordBatch:
            at, *columns = zip(*got) if got else [[]] * (1 + len(names))
            return pa.record_batch([part.column(key).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, types)]], names=[key, *names])

        for batch in batches:
            for part, texts in chunks(batch, "__text", CHUNK_CHARS):
                got, size = [], 0
                for row in split_texts(texts, limits, tokenizer, folder):
                    got.append(row)
                    size += len(row[8] or "")
                    if size > 1 << 22:
                        yield out(part, got)
                        got, size = [], 0
                yield out(part, got)

    return rows.mapInArrow(
        run, f"`{key}` {dict(rows.dtypes)[key]}, limit_name string, piece_no int, n_pieces int, start_char bigint, end_char bigint, overlap_chars bigint, n_tokens int, piece string, reason string"
    )
