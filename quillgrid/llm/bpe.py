"""Byte-level BPE over columns of text, vectorised with numpy.

Distinct pre-tokens are encoded as rows of length-bucketed padded matrices: in each
round every row merges its minimum-rank pair (all non-overlapping places of it, left to
right, which equals merging the leftmost one again and again, because a pair that holds a
new token always has a higher rank).  Pairs are looked up in an open-addressing hash
table; merged rows are compacted by a stable partition of the kept positions.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: Where the public vocabularies lie; a parameter of every operator that counts tokens.
TOKENIZER_DIR = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NO_RANK = np.int32(2**31 - 1)
#: Pre-tokens kept per worker; the cache is emptied when it is full, results never depend on it.
CACHE_ENTRIES = 400_000
#: Cells of one padded matrix; longer buckets are cut into blocks of rows.
BLOCK_CELLS = 1 << 21


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Open-addressing table from a pair of ids to (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = int(np.ceil(np.log2(len(left) * 4)))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NO_RANK, np.int32)
        self.merged = np.zeros(size, np.int32)
        key = self.key(left, right)
        todo, slot = np.arange(len(key)), self.slot(key)
        while len(todo):
            free = self.keys[slot] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]] = key[todo[put]]
            self.rank[slot[put]] = todo[put]
            self.merged[slot[put]] = merged[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & (size - 1)
        # A slot without its own pair ends a search.

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 20) | right.astype(np.int64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return mixed.astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        key = self.key(left, right)
        slot = self.slot(key)
        out = np.full(key.shape, -1, np.int64)
        at = np.arange(key.size)
        flat, k = slot.ravel(), key.ravel()
        res = out.ravel()
        while len(at):
            there = self.keys[flat]
            hit = there == k
            res[at[hit]] = flat[hit]
            more = ~hit & (there != -1)
            at, flat, k = at[more], (flat[more] + 1) & (len(self.keys) - 1), k[more]
        return res.reshape(key.shape)


class ByteBpe:
    """The encoder of one byte-level BPE file in `tokenizers` JSON form."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, alphabet = model["vocab"], byte_alphabet()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.table = PairTable(
            np.array([vocab[a] for a, _ in pairs], np.int32),
            np.array([vocab[b] for _, b in pairs], np.int32),
            np.array([vocab[a + b] for a, b in pairs], np.int32),
        )
        self.byte_id = np.zeros(256, np.int32)
        #: joined[a, b]: some token holds byte a followed by byte b; elsewhere no merge can ever cross.
        self.joined = np.zeros((256, 256), bool)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        for a, b in pairs:
            raw = [alphabet[c] for c in a + b]
            self.joined[raw[:-1], raw[1:]] = True
        self.split = regex.compile(PRETOKEN_PATTERN).findall
        self.cache: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.cache.clear()
        self.ids = np.zeros(1 << 20, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int64)

    # ---- matrices -------------------------------------------------------------------
    def merge_block(self, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of `m` (padded with -1; `n` ids each) until nothing merges."""
        m, n = m.copy(), n.copy()
        live = np.flatnonzero(n > 1)
        table = self.table
        slots = self.pair_slots(m)
        while len(live):
            rank = np.where(slots[live] >= 0, table.rank[slots[live]], NO_RANK)
            least = rank.min(axis=1)
            go = least < NO_RANK
            live, rank, least = live[go], rank[go], least[go]
            if not len(live):
                break
            hit = rank == least[:, None]
            hit = leftmost(hit)
            sub = m[live]
            row, col = np.nonzero(hit)
            sub[row, col] = table.merged[slots[live[row], col]]
            keep = sub >= 0
            keep[row, col + 1] = False
            left = keep.sum(axis=1)
            width = int(left.max())
            packed = np.full((len(live), sub.shape[1]), -1, np.int32)
            r, c = np.nonzero(keep)
            to = np.cumsum(keep, axis=1)[r, c] - 1
            packed[r, to] = sub[r, c]
            m[live] = packed
            n[live] = left
            if width < m.shape[1] * 3 // 4:
                # Every other row is finished and is moved out by the caller's width; narrow the work.
                inner, cnt = self.merge_block(packed[:, :width], left)
                m[live, :width] = inner
                m[live, width:] = -1
                n[live] = cnt
                break
            slots[live] = self.pair_slots(packed)
        return m, n

    def pair_slots(self, m: np.ndarray) -> np.ndarray:
        """Slot of the pair that begins at each place, -1 at a row's last id and beyond."""
        out = np.full(m.shape, -1, np.int64)
        ok = m[:, 1:] >= 0
        if ok.any():
            out[:, :-1][ok] = self.table.find(m[:, :-1][ok], m[:, 1:][ok])
        return out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row: as merge_block, with ranks updated only beside the merges."""
        table = self.table

        def ranks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = table.find(a, b)
            return np.where(s >= 0, table.rank[s], NO_RANK), s

        rank, slot = ranks(ids[:-1], ids[1:])
        while len(ids) > 1:
            least = rank.min()
            if least == NO_RANK:
                break
            at = np.flatnonzero(leftmost((rank == least)[None, :])[0])
            ids[at] = table.merged[slot[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))
            ids = ids[keep]
            pair_keep = keep[1:].copy()
            rank, slot = rank[pair_keep], slot[pair_keep]
            near = np.unique(np.concatenate([new - 1, new]))
            near = near[(near >= 0) & (near < len(ids) - 1)]
            if len(ids) > 1:
                rank[near], slot[near] = ranks(ids[near], ids[near + 1])
        return ids

    def encode_bytes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        # Cut where no token can cross: the parts are encoded on their own.
        cut = np.zeros(len(raw) + 1, bool)
        cut[0] = True
        cut[ends] = True
        if len(raw) > 1:
            cut[1:-1] |= ~self.joined[raw[:-1], raw[1:]]
        begin = np.flatnonzero(cut[:-1]) if len(raw) else np.zeros(0, np.int64)
        length = np.diff(np.append(begin, len(raw)))
        ids = self.byte_id[raw]
        total = np.ones(len(begin), np.int64)
        parts_flat = np.zeros(len(raw), np.int32)  # the ids of a part lie at its first bytes
        parts_flat[begin[length == 1]] = ids[begin[length == 1]]
        for low, high in bucket_edges(int(length.max(initial=0))):
            pick = np.flatnonzero((length > low) & (length <= high))
            if not len(pick):
                continue
            if high > 512:
                for k in pick:
                    got = self.merge_long(ids[begin[k] : begin[k] + length[k]].copy())
                    parts_flat[begin[k] : begin[k] + len(got)] = got
                    total[k] = len(got)
                continue
            step = max(1, BLOCK_CELLS // high)
            for i in range(0, len(pick), step):
                p = pick[i : i + step]
                width = int(length[p].max())
                col = np.arange(width)
                inside = col[None, :] < length[p][:, None]
                m = np.full((len(p), width), -1, np.int32)
                m[inside] = ids[(begin[p][:, None] + col)[inside]]
                m, n = self.merge_block(m, length[p])
                total[p] = n
                done = col[None, : m.shape[1]] < n[:, None]
                parts_flat[(begin[p][:, None] + col[: m.shape[1]])[done]] = m[done]
        # Gather the parts in order.
        out = parts_flat[spread(begin, total)]
        part_word = np.searchsorted(ends, begin, side="right")
        counts = np.bincount(part_word, weights=total, minlength=len(words)).astype(np.int64)
        return out, counts

    # ---- texts ----------------------------------------------------------------------
    def learn(self, words: list[str]) -> None:
        """Encode pre-tokens that the cache lacks and keep them."""
        flat, counts = self.encode_bytes([w.encode("utf-8", "surrogatepass") for w in words])
        k, need = len(self.cache), self.used + len(flat)
        while len(self.ids) < need:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.starts) < k + len(words):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.ids[self.used : need] = flat
        self.counts[k : k + len(words)] = counts
        self.starts[k : k + len(words)] = self.used + np.cumsum(counts) - counts
        self.used = need
        self.cache.update(zip(words, range(k, k + len(words))))

    def pretokens(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
        """Pre-tokens of each text and their entries in the cache, one after the other."""
        if len(self.cache) > CACHE_ENTRIES or self.used > 8 * CACHE_ENTRIES:
            self.reset()
        parts = [self.split(t) if t else [] for t in texts]
        distinct: set[str] = set()
        for p in parts:
            distinct.update(p)
        new = [w for w in distinct if w not in self.cache]
        if new:
            self.learn(new)
        get = self.cache.__getitem__
        n = sum(map(len, parts))
        return parts, np.fromiter((e for p in parts for e in map(get, p)), np.int64, n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        parts, entry = self.pretokens(texts)
        counts = self.counts[entry]
        ids = self.ids[spread(self.starts[entry], counts)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        total = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(sizes)
        return ids, total[ends] - total[ends - sizes]


def leftmost(hit: np.ndarray) -> np.ndarray:
    """Of touching marks in a row keep the first, third, ...: merges may not overlap."""
    if not (hit[:, 1:] & hit[:, :-1]).any():
        return hit
    col = np.arange(hit.shape[1])
    start = hit.copy()
    start[:, 1:] &= ~hit[:, :-1]
    first = np.maximum.accumulate(np.where(start, col, -1), axis=1)
    return hit & ((col - first) % 2 == 0)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def bucket_edges(longest: int) -> list[tuple[int, int]]:
    """(1, 2], (2, 4], (4, 8] ... up to the longest."""
    edges, low = [], 1
    while low < longest:
        high = low * 2 if low >= 8 else low + 2
        edges.append((low, high))
        low = high
    return edges


@lru_cache(maxsize=4)
def byte_bpe(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> ByteBpe:
    """The encoder of a worker process, made once."""
    return ByteBpe(os.path.join(folder, f"{name}.json"))


@lru_cache(maxsize=4)
def counter(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """A function from a list of texts to their token counts, by the library's own encoder."""
    import base64

    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(name, pat_str=PRETOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
