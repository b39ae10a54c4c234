"""Operators on message arrays, delimiters, media tags, boxes and token arrays, all within a row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = "struct<role:string,content:string>"


def none(kind: str = MESSAGE) -> Column:
    return F.array().cast(f"array<{kind}>")


def pairs_of(messages: Column) -> Column:
    """Messages two by two as [query, response]; an odd tail is padded with null."""
    at = F.sequence(F.lit(1), F.size(messages), F.lit(2))
    content = lambda i: F.try_element_at(messages, i)["content"]
    return F.when(F.size(messages) > 0, F.transform(at, lambda i: F.array(content(i), content(i + 1)))).otherwise(none("array<string>"))


def merged_runs(messages: Column, roles: tuple[str, ...] = ("user", "assistant"), sep: str = "\n") -> Column:
    """Neighbours of one role as one message, for the given roles; null contents count as ''."""

    def step(acc: Column, m: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        text = lambda x: F.coalesce(x["content"], F.lit(""))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(m["role"].alias("role"), F.concat(text(last), F.lit(sep), text(m)).alias("content"))))
        same = F.coalesce(last["role"] == m["role"], F.lit(False)) & m["role"].isin(*roles)
        return F.when(same, grown).otherwise(F.concat(acc, F.array(F.struct(m["role"].alias("role"), m["content"].alias("content")))))

    return F.aggregate(messages, none(), step)


def alternating(messages: Column) -> Column:
    """User and assistant in turn: an empty user turn before a leading reply, a null reply after a last question."""
    turn = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), F.lit(content).cast("string").alias("content")))
    first = F.try_element_at(messages, F.lit(1))["role"]
    last = F.try_element_at(messages, F.lit(-1))["role"]
    head = F.when(first == "assistant", turn("user", "")).otherwise(none())
    tail = F.when(last == "user", turn("assistant", None)).otherwise(none())
    return F.concat(head, messages, tail)


def role_lines(messages: Column) -> Column:
    """'Role: content' lines; empty contents are left out."""
    kept = F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n")


def rendered(messages: Column, system: Column, begin: str = "<|im_start|>", end: str = "<|im_end|>\n") -> Column:
    """A conversation as one prompt; a null system is left out."""
    block = lambda role, content: F.concat(F.lit(begin), role, F.lit("\n"), F.coalesce(content, F.lit("")), F.lit(end))
    head = F.when(system.isNotNull(), block(F.lit("system"), system)).otherwise("")
    return F.concat(head, F.array_join(F.transform(messages, lambda m: block(m["role"], m["content"])), ""))


def split_at(text: Column, pattern: str) -> Column:
    """array<struct<key, content>> of the parts that begin with a delimiter; leading text has the key ''.

    `pattern` is a regular expression of the delimiters. All parts together give the text back.
    """
    keys = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    texts = F.split(text, pattern)
    pairs = F.zip_with(F.concat(F.array(F.lit("")), keys), texts, lambda k, t: F.struct(k.alias("key"), t.alias("content")))
    return F.filter(pairs, lambda p: (p["key"] != "") | (p["content"] != ""))


def first_leaf(nested: Column) -> Column:
    """The first element of nested arrays that is neither null nor ''."""
    return F.get(F.filter(F.flatten(nested), lambda x: x.isNotNull() & (x != "")), F.lit(0))


def find_all(items: Column, part: Column) -> Column:
    """0-based places at which `part` occurs in `items`."""
    n, k = F.size(items), F.size(part)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(none("int"))
    return F.filter(at, lambda i: F.slice(items, i + 1, k) == part)


def with_default_tags(text: Column, n_media: Column, tag: str = "<image>") -> Column:
    """Missing media tags put before the text."""
    missing = F.greatest(n_media - F.regexp_count(text, F.lit(tag)), F.lit(0))
    return F.concat(F.repeat(F.lit(tag), missing), text)


def inline_images(text: Column) -> tuple[Column, Column]:
    """(text with <image> in place of <img>path</img>, the paths)."""
    pattern = r"<img>(.+?)</img>"
    return F.regexp_replace(text, pattern, "<image>"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def box_text(box: Column) -> Column:
    """[(x,y),(x,y)] of a box of whole numbers."""
    pair = lambda i: F.concat(F.lit("("), F.get(box, i).cast("string"), F.lit(","), F.get(box, i + 1).cast("string"), F.lit(")"))
    return F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.size(box) - 2, F.lit(2)), pair), ","), F.lit("]"))


def scaled_box(box: Column, width: Column, height: Column, to: int = 1000) -> Column:
    """Pixels as parts of `to`, rounded half to even."""
    return F.transform(box, lambda v, i: F.bround(v / F.when(i % 2 == 0, width).otherwise(height) * to, 0).cast("bigint"))


def filled_tags(text: Column, tag: str, values: Column) -> Column:
    """Each place of `tag` replaced by the next value; places beyond the values keep the tag."""
    rest = F.split(text, tag)
    filled = F.transform(rest, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(values, i - 1), F.lit(tag)), p)))
    return F.array_join(filled, "")


def labels_of(ids: Column, scales: Column) -> Column:
    """The ids where the scale is above 0, else -100."""
    return F.zip_with(ids, scales, lambda t, s: F.when(s > 0, t).otherwise(-100))


def truncated_ids(ids: Column, most: int, protected: list[int], side: str = "right") -> Column:
    """At most `most` ids: protected ones stay, of the rest the first ('right' is cut) or last ones."""
    is_kept = lambda t: t.isin(protected)
    room = F.greatest(F.lit(most) - F.size(F.filter(ids, is_kept)), F.lit(0))
    other = F.transform(ids, lambda t: F.when(is_kept(t), 0).otherwise(1))
    total = F.aggregate(other, F.lit(0), lambda a, x: a + x)
    rank = F.transform(F.sequence(F.lit(1), F.size(ids)), lambda i: F.aggregate(F.slice(other, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    keep = lambda i: F.get(rank, i) <= room if side == "right" else F.get(rank, i) > total - room
    return F.when(F.size(ids) <= most, ids).otherwise(F.filter(ids, lambda t, i: is_kept(t) | keep(i)))


def expanded(ids: Column, placeholder: int, n: Column) -> Column:
    """Each placeholder id n times."""
    return F.flatten(F.transform(ids, lambda t: F.when(t == placeholder, F.array_repeat(t, n)).otherwise(F.array(t))))


def merged_contexts(contexts: Column) -> Column:
    """Neighbours of equal loss scale as one (text, scale)."""

    def step(acc: Column, c: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(F.concat(last["text"], c["text"]).alias("text"), c["scale"].alias("scale"))
        same = F.coalesce(last["scale"] == c["scale"], F.lit(False))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(contexts, none("struct<text:string,scale:double>"), step)


def without_reasoning(text: Column) -> Column:
    """What follows the last </think>."""
    return F.element_at(F.split(text, "</think>"), -1)


def split_list(items: Column, sep: Column) -> Column:
    """The array cut at a separator element, which goes."""
    joined = F.concat(F.array(F.lit(-1)), find_all(items, F.array(sep)), F.array(F.size(items)))
    return F.transform(F.sequence(F.lit(1), F.size(joined) - 1), lambda i: F.slice(items, F.get(joined, i - 1) + 2, F.get(joined, i) - F.get(joined, i - 1) - 1))


def boxed(text: Column) -> Column:
    r"""The first \boxed{...} without inner braces; '' if none."""
    return F.regexp_extract(text, r"\\boxed\{([^{}]+)\}", 1)


def has_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\x{4e00}-\x{9fff}]"), F.lit(False))


def media_type(name: Column) -> Column:
    """image, video or audio by a file's ending; null for others."""
    end = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"image": ["jpg", "jpeg", "png", "gif", "bmp", "webp"], "video": ["mp4", "avi", "mov", "mkv", "webm"], "audio": ["mp3", "wav", "flac", "ogg", "m4a"]}
    out = F.lit(None).cast("string")
    for k, v in kinds.items():
        out = F.when(end.isin(v), k).otherwise(out)
    return out


def even_part(i: Column, n: Column, shards: int, contiguous: bool = True) -> Column:
    """Shard of the 0-based i-th of n items."""
    return F.floor(i * shards / n).cast("int") if contiguous else (i % shards).cast("int")


def frame_indices(total: Column, n: int) -> Column:
    """n indices spread evenly over `total` frames."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor((i + F.lit(0.5)) * total / n).cast("int"))


def capped_size(width: Column, height: Column, most: int) -> Column:
    """(width, height) of an image scaled down to at most `most` pixels, ratio kept."""
    ratio = F.sqrt(F.least(F.lit(1.0), F.lit(float(most)) / (width * height)))
    return F.struct(F.floor(width * ratio).cast("int").alias("width"), F.floor(height * ratio).cast("int").alias("height"))


def lower_bound(values: Column, least: Column) -> Column:
    """First 0-based place of a sorted array whose value is at least `least`; the size if none."""
    return F.size(F.filter(values, lambda x: x < least))


def upper_bound(values: Column, most: Column) -> Column:
    """Places whose value is at most `most`."""
    return F.size(F.filter(values, lambda x: x <= most))


def padded(items: Column, size: Column, value, left: bool = False) -> Column:
    """Filled with `value` up to `size`."""
    fill = F.array_repeat(F.lit(value), F.greatest(size - F.size(items), F.lit(0)))
    return F.concat(fill, items) if left else F.concat(items, fill)


def closest_ratio(width: Column, height: Column, ratios: list[tuple[int, int]], size: int) -> Column:
    """The (w, h) of a list nearest to an image's ratio; on ties the later one if the image is large enough."""
    table = F.array(*[F.struct(F.lit(a).alias("w"), F.lit(b).alias("h")) for a, b in ratios])
    ratio = width / height
    off = lambda r: F.abs(ratio - r["w"] / r["h"])

    def step(best: Column, r: Column) -> Column:
        large = width * height > 0.5 * size * size * r["w"] * r["h"]
        return F.when((off(r) < off(best)) | ((off(r) == off(best)) & large), r).otherwise(best)

    return F.aggregate(F.slice(table, 2, max(len(ratios) - 1, 1)), F.get(table, F.lit(0)), step)


def fingerprint(columns: dict[str, Column]) -> Column:
    """MD5 of the row as JSON with its keys in order; null fields are left out."""
    return F.md5(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])))


def printable(value: Column, most: int = 1000) -> Column:
    """Long strings by their first 50 characters."""
    return F.when(F.char_length(value) >= most, F.concat(F.lit("<<<base64:"), F.left(value, F.lit(50)), F.lit("..>>>"))).otherwise(value)


def with_think_prefix(messages: Column, prefix: str, last_round_only: bool) -> Column:
    """Replies without <think> get the prefix; with last_round_only earlier replies lose their reasoning."""
    n = F.size(messages)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def one(m: Column, i: Column) -> Column:
        c = F.when(m["content"].startswith("<think>") | m["content"].startswith(prefix), m["content"]).otherwise(F.concat(F.lit(prefix), m["content"]))
        if last_round_only:
            c = F.when(i < n - 1, strip(without_reasoning(c))).otherwise(c)
        return F.struct(m["role"].alias("role"), F.when((m["role"] == "assistant") & m["content"].isNotNull(), c).otherwise(m["content"]).alias("content"))

    return F.transform(messages, one)


def media_bytes(value: Column) -> Column:
    """Bytes of a base64 data URL or plain base64; null for anything else."""
    return F.try_to_binary(F.substring_index(value, ",", -1), F.lit("base64"))


def with_dynamic_end(ids: Column, labels: Column, end: list[int]) -> Column:
    """Labels with the end tokens supervised that open a masked gap between two supervised stretches."""
    k = len(end)
    mark = F.array(*map(F.lit, end))
    opens = lambda p: (p > 0) & (F.get(labels, p - 1) >= 0) & F.forall(F.slice(labels, p + 1, k), lambda x: x == -100)
    inner = lambda p: F.exists(F.slice(labels, p + k + 1, F.size(labels)), lambda x: x >= 0)
    places = F.filter(find_all(ids, mark), lambda p: opens(p) & inner(p))
    return F.transform(labels, lambda x, i: F.when(F.exists(places, lambda p: (p <= i) & (i < p + k)), F.get(ids, i)).otherwise(x))


def split_media(parts: Column) -> tuple[Column, Column]:
    """Content parts of (type, text, url) as (text with a tag for each medium, the urls); x_url counts as x."""
    kind = lambda p: F.regexp_replace(p["type"], "_url$", "")
    text = F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.concat(F.lit("<"), kind(p), F.lit(">")))), "")
    return text, F.transform(F.filter(parts, lambda p: p["type"] != "text"), lambda p: p["url"])


def task_row(parts: dict[str, Column], fields: list[str]) -> list[Column]:
    """Encoded rows of a task side by side: name_field for each part, as in preference or pair training."""
    return [part[f].alias(f"{name}_{f}") for name, part in parts.items() for f in fields]


def start_image(messages: Column, tag: str = "<start-image>") -> Column:
    """(messages, generate): whether the last message is the user's and ends in the tag, which is then taken off."""
    last = F.try_element_at(messages, F.lit(-1))
    hit = F.coalesce((last["role"] == "user") & last["content"].endswith(tag), F.lit(False))
    n = F.size(messages)
    cut = F.transform(messages, lambda m, i: F.when((i == n - 1) & hit, F.struct(m["role"].alias("role"), F.left(m["content"], F.length(m["content"]) - len(tag)).alias("content"))).otherwise(m))
    return F.struct(cut.alias("messages"), hit.alias("generate"))


def length_policy(df: DataFrame, ids: str, most: int, policy: str, protected: list[int] | None = None) -> DataFrame:
    """Rows whose ids are too long: 'delete' drops them, 'raise' fails the query, 'left' and 'right' cut them."""
    if policy == "delete":
        return df.where(F.size(ids) <= most)
    if policy == "raise":
        fail = F.raise_error(F.concat(F.lit("too long: "), F.size(ids).cast("string"), F.lit(f" > {most}")))
        return df.withColumn(ids, F.when(F.size(ids) <= most, F.col(ids)).otherwise(fail.cast(df.schema[ids].dataType)))
    return df.withColumn(ids, truncated_ids(F.col(ids), most, protected or [], policy))


@F.pandas_udf(T.StructType().add("ids", T.ArrayType(T.LongType())).add("labels", T.ArrayType(T.LongType())))
def aligned_labels(ids: pd.Series, labels: pd.Series, encoded: pd.Series, placeholder: pd.Series) -> pd.DataFrame:
    """Ids whose placeholders an encoder has made into runs, with -100 as labels of these runs.

    The texts between placeholders are found again one after another by their first id; a
    text that isn't there gives null.
    """

    def one(old, marks, new, hole):
        at, out, kept = 0, [], []
        bounds = [k for k, x in enumerate(old) if x == hole] + [len(old)]
        begin = 0
        for b in bounds:
            part, part_marks = list(old[begin:b]), list(marks[begin:b])
            if part:
                try:
                    found = list(new).index(part[0], at)
                except ValueError:
                    return None
            else:
                found = len(new) if b == len(old) else at
            out += list(new[at:found]) + part
            kept += [-100] * (found - at) + part_marks
            at, begin = found + len(part), b + 1
        return out, kept

    got = [None if o is None or n is None else one(o, m if m is not None else [-100] * len(o), n, h) for o, m, n, h in zip(ids, labels, encoded, placeholder)]
    return pd.DataFrame({"ids": [g and g[0] for g in got], "labels": [g and g[1] for g in got]})
