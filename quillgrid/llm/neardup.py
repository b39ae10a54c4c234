"""Near-duplicate records by a blocked sparse product of distinct word sets.

The incidence matrix has a row for each distinct set of words and a column for each chain of
words in it, in one order of all words, the rarest first. Two sets that are at least the
threshold alike have a least number of words in common, so the first k of these lie in the
first words of both sets, up to a length that the size gives (a prefix filter of k words):
no such pair can be missed, whatever the order of words in the texts. A set's columns are the
words of its prefix; a column that many sets have is replaced by the columns of that word and
each later word of the prefix, and those that are still hot by chains of `DEPTH` words. A
column that is long even so is cut into blocks of sets. The product is formed block by block,
each two blocks of a column by a join under a name of their own; pairs out of reach by their
sizes, by what is left after the chain, or by the bits of their sets are discarded as they
arise, and the rest are compared over their whole word sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components

#: A word is a maximal run of letters or digits.
WORD = r"[\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")
_ASCII = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else 32 for b in range(256))
#: Words whose hashes a worker keeps; results don't depend on it.
KEPT_WORDS = 500_000
#: Longest chain of words that makes a column.
DEPTH = 3
#: A chain that more sets have than this, and twice the mean of its table, is hot and is lengthened.
HOT = 192
#: Cells of the tables of counts by word and by chain. Fixed: they never grow with the data, and a
#: cell that several share can only make a chain longer, never lose a pair.
CELLS = 1 << 19
CHUNK_BITS = 12
#: Sets of a block of a column: a column of more is cut into blocks, and every two of them meet on their own.
BLOCK = 1024
#: Sets whose chains are formed at a time.
SLICE = 1000
#: Up to so many candidate pairs the ids in them are broadcast: 8 MB of ids at most.
FEW_PAIRS = 500_000
#: 64-bit parts of a set's bits: each tells whether an odd number of its words falls on it.
BITMAP = 2


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def words_in(texts: list[str]) -> list[list]:
    """The words of some texts in lower case, one after another: all as bytes if all texts are ASCII, else all as strings."""
    if all(map(str.isascii, texts)):
        return [t.encode("ascii").translate(_ASCII).split() for t in texts]
    return [_WORD.findall(t.lower()) for t in texts]


def code_of(word: bytes | str) -> int:
    return int.from_bytes(blake2b(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"), digest_size=8).digest())


def word_rows(df: DataFrame, key: str, texts: list[str], counted: str | None, min_words: int, words: bool = True) -> DataFrame:
    """(id, fp, words): the hashed distinct words of the texts taken together, sorted, and a hash of that set; without `words` (id, fp)."""
    kind = dict(df.select(F.col(key).alias("id")).dtypes)["id"]
    rows = df.select(F.col(key).alias("id"), *[F.col(t).alias(f"t{k}") for k, t in enumerate(texts)])
    least = texts.index(counted) if counted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes | str, int] = {}
        for batch in batches:
            if len(codes) > KEPT_WORDS:
                codes.clear()
            at, sets, sizes = [], [], []
            for k, row in enumerate(zip(*[batch.column(f"t{k}").to_pylist() for k in range(len(texts))])):
                if len((row[least] if least is not None else "".join(filter(None, row))) or "") < 2 * min_words - 1:
                    continue  # too few characters to hold so many words
                found = words_in([t or "" for t in row])
                if (len(found[least]) if least is not None else sum(map(len, found))) < min_words:
                    continue
                one = set().union(*found)
                if one:
                    at.append(k)
                    sets.append(one)
                    sizes.append(len(one))
            for w in set().union(*sets) - codes.keys():
                codes[w] = code_of(w)
            size = np.array(sizes, np.int64)
            row, code = np.repeat(np.arange(len(size)), size), np.fromiter(map(codes.__getitem__, chain.from_iterable(sets)), np.uint64, int(size.sum()))
            start = np.cumsum(size) - size
            fp = mix(np.add.reduceat(mix(code), start) + size.astype(np.uint64)) if len(size) else np.zeros(0, np.uint64)
            columns = [batch.column("id").take(pa.array(at, pa.int32())), pa.array(fp.view(np.int64))]
            if words:
                order = np.lexsort((code, row))
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(start, len(code)).astype(np.int32)), pa.array(code[order].view(np.int64))))
            yield pa.record_batch(columns, names=["id", "fp", "words"][: len(columns)])

    return rows.mapInArrow(run, f"id {kind}, fp bigint" + ", words array<bigint>" * words)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def cell_of(sig: np.ndarray) -> np.ndarray:
    return (sig & np.uint64(CELLS - 1)).astype(np.int64)


def lists_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists one after another, and the size of each list."""
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(lists.offsets.to_numpy()).astype(np.int64)


def cell_counts(df: DataFrame, keys_of) -> np.ndarray:
    """Counts by cell of the keys that `keys_of` gives for each batch; CELLS numbers, however many keys.

    They are summed by cell and come to the driver as 2^CHUNK_BITS cells a row, empty ones
    included, so that what is sent is the same for any data.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for part in slices(b):
                total += np.bincount(cell_of(keys_of(part)), minlength=CELLS)
        cell = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cells, n in zip(b.column("cell").to_pylist(), b.column("n").to_pylist()):
                part = np.zeros(1 << CHUNK_BITS, np.float32)
                part[np.array(cells) & ((1 << CHUNK_BITS) - 1)] = n
                out.append(part.tobytes())
            yield pa.record_batch([b.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "n"])

    sums = df.mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = sums.groupBy(F.shiftright("cell", CHUNK_BITS).alias("chunk")).agg(F.collect_list("cell").alias("cell"), F.collect_list("n").alias("n"))
    counts = np.zeros((CELLS >> CHUNK_BITS, 1 << CHUNK_BITS), np.float32)
    got = rows.mapInArrow(dense, "chunk int, n binary").toArrow()
    for chunk, n in zip(got.column("chunk").to_pylist(), got.column("n").to_pylist()):
        counts[chunk] = np.frombuffer(n, np.float32)
    return counts.ravel()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, SLICE):
        yield batch.slice(k, SLICE)


def prefixes_of(batch: pa.RecordBatch, rarity: np.ndarray, t: Fraction, first_id: int) -> pa.RecordBatch:
    """(id, fp, size, prefix, b0 ...): the rarest words of each set, as many as chains may need, and the bits of all its words; two sets differ in at least as many words as bits."""
    word, size = lists_of(batch, "words")
    word = mix(word)
    row = np.repeat(np.arange(len(size)), size)
    bit = (word % np.uint64(64 * BITMAP)).astype(np.int64)
    bits = []
    for k in range(BITMAP):
        mine = bit // 64 == k
        b = np.zeros(len(size), np.uint64)
        np.bitwise_xor.at(b, row[mine], np.uint64(1) << (bit[mine] % 64).astype(np.uint64))
        bits.append(pa.array(b.view(np.int64)))
    keep = np.minimum(size, size - least_of(size, t) + DEPTH)
    order = np.lexsort((word, rarity[cell_of(word)], row))  # rarest first; equal rarity by the word itself
    rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    kept = word[order][rank < keep[row]]
    prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(kept.view(np.int64)))
    return pa.record_batch(
        [pa.array(first_id + np.arange(len(size))), batch.column("fp"), pa.array(size.astype(np.int32)), prefix, *bits], names=["id", "fp", "size", "prefix", *[f"b{k}" for k in range(BITMAP)]]
    )


def least_of(size: np.ndarray, t: Fraction) -> np.ndarray:
    """Words that a set of this size has in common with any set that is alike, at least."""
    return -(-size * t.numerator // t.denominator)


def hot(counts: np.ndarray) -> np.ndarray:
    """Cells of columns that are lengthened."""
    return counts > HOT + 2 * counts.mean()


def blocks_of(counts: np.ndarray) -> np.ndarray:
    """Blocks of the columns of each cell."""
    return np.maximum(np.ceil(counts / BLOCK), 1).astype(np.int32)


def chains_of(batch: pa.RecordBatch, tables: list[np.ndarray], t: Fraction) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of chains up to one more than there are tables of hot cells: (row, position
    of the last word, key, whether it is a column, not lengthened)."""
    flat, held = lists_of(batch, "prefix")
    size = np.asarray(batch.column("size")).astype(np.int64)
    least, start = least_of(size, t), np.cumsum(held) - held
    out = []
    row = np.repeat(np.arange(len(size)), held)
    pos = np.arange(len(flat)) - start[row]
    first = pos < (size - least + 1)[row]
    row, pos = row[first], pos[first]
    key = mix(flat[start[row] + pos])
    for depth in range(1, len(tables) + 2):
        if depth > len(tables):
            out.append((row, pos, key, np.ones(len(row), bool)))
            break
        longer = tables[depth - 1][cell_of(key)]
        # A set that may have no more in common with another than this chain keeps the chain too.
        out.append((row, pos, key, ~longer | (least[row] <= depth)))
        row, pos, key = row[longer], pos[longer], key[longer]
        more = np.maximum(np.minimum(held, size - least + depth + 1)[row] - pos - 1, 0)
        of = np.repeat(np.arange(len(row)), more)
        step = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more)
        row, pos, key = row[of], pos[of] + 1 + step, key[of]
        key = mix(key * np.uint64(3) + flat[start[row] + pos])
    return out


def postings_of(batch: pa.RecordBatch, tables: list[np.ndarray], blocks: list[np.ndarray], t: Fraction) -> pa.RecordBatch:
    """The columns of a batch of sets: (col, id, meta, b0 ...); meta is the number of words, of words that a
    pair first alike in this chain can have in common at most, and the side on which the set stands.

    A set of a column of k blocks stands in one of them, which meets itself (side 0) and the
    blocks before (side 1 there) and after it (side 2 there), each under a name of its own.
    """
    size = np.asarray(batch.column("size")).astype(np.int64)
    ids = np.asarray(batch.column("id")).astype(np.int64)
    rows, metas, keys, cuts = [], [], [], []
    for depth, (row, pos, key, mine) in enumerate(chains_of(batch, tables, t), 1):
        row, pos, key = row[mine], pos[mine], key[mine]
        rows.append(row)
        keys.append(key)
        metas.append(size[row] << 33 | (depth + size[row] - pos - 1) << 2)
        cuts.append(blocks[depth - 1][cell_of(key)].astype(np.int64))
    row, key, meta, k = (np.concatenate(x) for x in (rows, keys, metas, cuts))
    of = np.repeat(np.arange(len(row)), k)
    other = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
    own = (mix(ids[row].astype(np.uint64) + np.uint64(1)) % np.maximum(k, 1).astype(np.uint64)).astype(np.int64)[of]
    side = np.where(own == other, 0, np.where(own < other, 1, 2))
    pair = np.minimum(own, other) * np.int64(1 << 20) + np.maximum(own, other)
    col = np.where(k[of] == 1, key[of], mix(key[of] + (pair + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    names = [f"b{k}" for k in range(BITMAP)]
    bits = [batch.column(n).take(pa.array(row[of])) for n in names]
    return pa.record_batch([pa.array(col.view(np.int64)), pa.array(ids[row[of]]), pa.array(meta[of] | side), *bits], names=["col", "id", "meta", *names])


def similar_texts(distinct: DataFrame, t: Fraction) -> DataFrame:
    """(a, b), a < b: pairs of distinct word sets (fp, words) that have |a & b| >= t |a | b|."""
    sc = distinct.sparkSession.sparkContext
    rarity = sc.broadcast(cell_counts(distinct.select("words"), lambda b: mix(lists_of(b, "words")[0])))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        first = pyspark.TaskContext.get().partitionId() << 33
        for b in batches:
            if b.num_rows:
                yield prefixes_of(b, rarity.value, t, first)
                first += b.num_rows

    bits = [f"b{k}" for k in range(BITMAP)]
    prefixes = stored(distinct.mapInArrow(shorten, "id bigint, fp bigint, size int, prefix array<bigint>, " + ", ".join(f"{b} bigint" for b in bits)))
    tables, blocks = sc.broadcast([]), []
    for depth in range(1, DEPTH + 1):
        known = tables
        counts = cell_counts(prefixes.select("size", "prefix"), lambda b: chains_of(b, known.value, t)[-1][2])
        blocks.append(blocks_of(counts))
        if depth < DEPTH:
            tables = sc.broadcast([*known.value, hot(counts)])
    cuts = sc.broadcast(blocks)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                yield postings_of(part, tables.value, cuts.value, t)

    rows = prefixes.select("id", "size", "prefix", *bits).mapInArrow(kept, "col bigint, id bigint, meta bigint, " + ", ".join(f"{b} bigint" for b in bits))
    x, y = rows.alias("x"), rows.alias("y")
    num, den = t.numerator, t.denominator
    sx, sy = F.shiftright("x.meta", 33), F.shiftright("y.meta", 33)
    most = F.least(*[F.shiftright(F.col(f"{r}.meta").bitwiseAND((1 << 33) - 1), 2) for r in "xy"])
    # Both sides in one number: a condition on one side alone would be pushed below the shuffle, which both sides then couldn't share.
    sides = F.col("x.meta").bitwiseAND(3) * 4 + F.col("y.meta").bitwiseAND(3)
    met = ((sides == 0) & (F.col("x.id") < F.col("y.id"))) | (sides == 6)
    apart = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in bits), F.lit(0))
    reach = met & (sx * den >= sy * num) & (sy * den >= sx * num) & (most * (den + num) >= (sx + sy) * num) & (apart * (den + num) <= (sx + sy) * (den - num))
    pairs = x.join(y, (F.col("x.col") == F.col("y.col")) & reach).select(F.least("x.id", "y.id").alias("x"), F.greatest("x.id", "y.id").alias("y")).distinct()
    for r in "xy":
        pairs = pairs.join(prefixes.select(F.col("id").alias(r), F.col("fp").alias(f"{r}f")), r)
    pairs = stored(pairs.select(F.least("xf", "yf").alias("a"), F.greatest("xf", "yf").alias("b")))
    # Only sets in a candidate pair are moved. Their ids are broadcast if they are few, else joined by hash.
    ids = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    asked = distinct.join(F.broadcast(ids) if pairs.count() <= FEW_PAIRS else ids, "fp", "left_semi")
    a = asked.select(F.col("fp").alias("a"), F.col("words").alias("wa"))
    b = asked.select(F.col("fp").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("n", F.size(F.array_intersect("wa", "wb")))
    return both.where(F.col("n") * den >= (F.size("wa") + F.size("wb") - F.col("n")) * num).select("a", "b")


def near_duplicates(
    df: DataFrame, key: str, texts: list[str], counted: str | None = None, min_words: int = 1, threshold: Fraction = Fraction(3, 4)
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the rows of `df` whose texts are versions of one another.

    members (id, fp): each key once with its class of equal word sets; pairs (a, b) link
    classes whose Jaccard similarity of distinct words is at least `threshold`. Rows whose
    column `counted` has fewer than `min_words` words, and rows without any word (null,
    empty and blank texts), take no part. Keys that come again with the same words count
    once. An empty table gives two empty results; other columns of `df` are ignored.
    """
    members = stored(word_rows(df, key, texts, counted, min_words, words=False).distinct())
    distinct = stored(word_rows(df, key, texts, counted, min_words).select("fp", "words").dropDuplicates(["fp"]))
    return members, stored(similar_texts(distinct, threshold))


def version_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of rows, those of one class included."""
    m = members
    same = m.alias("x").join(m.alias("y"), (F.col("x.fp") == F.col("y.fp")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    across = (
        pairs.join(m.select(F.col("fp").alias("a"), F.col("id").alias("i")), "a")
        .join(m.select(F.col("fp").alias("b"), F.col("id").alias("j")), "b")
        .where("i <> j")
        .select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    )
    return same.unionByName(across).distinct()


def version_groups(members: DataFrame, pairs: DataFrame, singles: bool = False) -> DataFrame:
    """(id, group_id, group_size, n_links): one row for each row that has a version, or with `singles` for each row.

    group_id is the smallest id of the group; n_links counts the other rows directly linked.
    """
    sizes = members.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    other = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = other.join(sizes.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    label = components(pairs)
    classes = (
        sizes.join(across, "fp", "left")
        .join(label.select(F.col("node").alias("fp"), "label"), "fp", "left")
        .withColumn("label", F.coalesce("label", "fp"))
        .withColumn("n_links", F.col("n") - 1 + F.coalesce("others", F.lit(0)))
        .where("true" if singles else "n_links > 0")
    )
    groups = classes.groupBy("label").agg(F.min("first").alias("group_id"), F.sum("n").alias("group_size"))
    return members.join(classes.select("fp", "label", "n_links"), "fp").join(groups, "label").select("id", "group_id", "group_size", "n_links")


def wordless_rows(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(id, group_id, group_size, n_links): rows that have a text but no word in it, each its own group."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts])
    rows = df.where(F.coalesce(*texts).isNotNull() & ~text.rlike(WORD)).select(F.col(key).alias("id")).distinct()
    return rows.select("id", F.col("id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(0).cast("bigint").alias("n_links"))
