"""Row-level operators of a conversation dataset: renames, checks, and standard rows."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of a standard row and the aliases of its columns.
STANDARD_KEYS = [
    "messages", "rejected_response", "rejected_images", "images", "videos", "audios", "tools", "objects", "label", "channel", "margin", "solution",
    "positive_messages", "negative_messages", "rejected_messages", "rejected_tools", "loss", "chat_template_kwargs",
]
ALIASES = {
    **dict.fromkeys(["image", "images"], "images"), **dict.fromkeys(["audio", "audios"], "audios"), **dict.fromkeys(["video", "videos"], "videos"),
    **dict.fromkeys(["system", "system_prompt"], "system"),
    **dict.fromkeys(["query", "prompt", "input", "instruction", "question", "problem"], "query"),
    **dict.fromkeys(["response", "answer", "output", "targets", "target", "answer_key", "answers", "solution", "text", "completion", "content"], "response"),
    **dict.fromkeys(["conversation", "conversations", "messages"], "messages"),
}
ROLES = ["system", "user", "tool_call", "tool_response", "tool", "assistant"]


def rename_plan(columns: list[str], mapping: dict[str, str]) -> dict[str, str]:
    """Renames to apply: names compare without case, a target that several columns map to is
    taken by none of them, identities drop out afterwards (so a column keeps its own name)."""
    low = {k.lower(): v for k, v in mapping.items()}
    hits = {c: low[c.lower()] for c in columns if c.lower() in low}
    several = {t for t, n in Counter(hits.values()).items() if n > 1}
    return {c: t for c, t in hits.items() if t not in several and c != t}


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(rename_plan(df.columns, mapping))


def standard_only(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The standard keys and `extra`, in the frame's order."""
    keep = set(STANDARD_KEYS) | set(extra or [])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep])


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Columns `prefix`x as x; a column x that exists wins and the prefixed one is dropped."""
    here = set(df.columns)
    out = []
    for c in df.columns:
        if not c.startswith(prefix):
            out.append(F.col(f"`{c}`"))
        elif c[len(prefix) :] not in here:
            out.append(F.col(f"`{c}`").alias(c[len(prefix) :]))
    return df.select(*out)


def valid_messages(messages: Column) -> Column:
    """At least one message, known roles only, no null content."""
    return F.coalesce((F.size(messages) > 0) & F.forall(messages, lambda m: m["role"].isin(ROLES) & m["content"].isNotNull()), F.lit(False))


def media(paths: Column) -> Column:
    """Paths as array<struct<bytes, path>>; null stays null."""
    return F.transform(paths, lambda p: F.struct(F.lit(None).cast("binary").alias("bytes"), p.alias("path")))


def rejected_differs(messages: Column, rejected: Column) -> Column:
    """A rejected response is there and isn't the last message."""
    return rejected.isNotNull() & (F.try_element_at(messages, F.lit(-1))["content"] != rejected)


def ordered_box(box: Column) -> Column:
    """A box of 2 or 4 numbers with its corners in order; null for other lengths."""
    b = lambda k: F.get(box, F.lit(k))
    four = F.array(F.least(b(0), b(2)), F.least(b(1), b(3)), F.greatest(b(0), b(2)), F.greatest(b(1), b(3)))
    return F.when(F.size(box) == 4, four).when(F.size(box) == 2, box)


def joined_prompt(instruction: Column, given: Column) -> Column:
    """instruction and input on two lines, or whichever isn't empty; '' if both are."""
    return F.concat_ws("\n", F.nullif(instruction, F.lit("")), F.nullif(given, F.lit("")))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def history_messages(history: Column, system: Column, user: str = "user", assistant: str = "assistant") -> Column:
    """History pairs as messages, the system first; null halves and a null or empty system are left out."""
    pairs = F.flatten(F.transform(F.coalesce(history, F.array().cast("array<array<string>>")), lambda h: F.array(_message(user, F.get(h, F.lit(0))), _message(assistant, F.get(h, F.lit(1))))))
    head = F.when(F.coalesce(system, F.lit("")) != "", F.array(_message("system", system))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return F.concat(head, F.filter(pairs, lambda m: m["content"].isNotNull()))


def response_messages(system: Column, history: Column, query: Column, response: Column) -> Column:
    """A row of system, history, query and response as messages."""
    last = F.filter(F.array(_message("user", query), _message("assistant", response)), lambda m: m["content"].isNotNull())
    return F.concat(history_messages(history, system), last)


def standard_roles(messages: Column, role_key: str, content_key: str, users: list[str], assistants: list[str]) -> Column:
    """Messages of other key and role names as role and content."""
    role = lambda m: F.when(m[role_key].isin(users), "user").when(m[role_key].isin(assistants), "assistant").otherwise(m[role_key])
    return F.transform(messages, lambda m: F.struct(role(m).alias("role"), m[content_key].alias("content")))


def paired_messages(pairs: Column, human: str = "human", assistant: str = "assistant") -> Column:
    """Structs of a human and an assistant text as two messages each."""
    return F.flatten(F.transform(pairs, lambda p: F.array(_message("user", p[human]), _message("assistant", p[assistant]))))


def filled(template: str, query: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{{QUERY}}"), query)


def class_prompt(task: str, labels: list[str], text: Column, label: Column) -> tuple[Column, Column]:
    """(prompt, answer) of a classification; a null label has no answer."""
    head = f"Task: {task}\nSentence: "
    return F.concat(F.lit(head), text, F.lit(f"\nCategory: {', '.join(labels)}\nOutput:")), F.try_element_at(F.array(*map(F.lit, labels)), label + 1)


def family_of(columns: list[str]) -> str:
    """Which rules a table's columns ask for: messages, alpaca or response."""
    names = {c.lower() for c in columns}
    if names & {"conversation", "conversations", "messages"}:
        return "messages"
    return "alpaca" if {"instruction", "input"} <= names else "response"


def popped_reply(messages: Column) -> tuple[Column, Column]:
    """(messages without a last assistant reply, that reply or null)."""
    last = F.try_element_at(messages, F.lit(-1))
    ends = F.coalesce(last["role"] == "assistant", F.lit(False))
    return F.when(ends, F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages), F.when(ends, last["content"])


def pick(values: Column, row: Column, seed: int = 0) -> Column:
    """One element of an array, drawn by the hash of the row's id and a seed."""
    return F.get(values, F.pmod(F.xxhash64(row, F.lit(seed)), F.size(values)).cast("int"))


def chosen_and_rejected(messages: Column, rejected: Column) -> Column:
    """Messages whose last reply is the rejected response; the turns up to the last user turn are shared."""
    users = F.filter(F.transform(messages, lambda m, i: F.when(m["role"].isin("user", "tool"), i + 1)), lambda i: i.isNotNull())
    upto = F.coalesce(F.array_max(users), F.lit(0))
    return F.concat(F.slice(messages, F.lit(1), upto), F.array(_message("assistant", rejected)))


def checked(df: DataFrame, rules: dict[str, Column], strict: bool = False) -> DataFrame:
    """`df` with `reason`: the first rule a row breaks, or null. strict: such a row ends the query.

    Rows to drop are those with a reason; they stay countable until they are filtered.
    """
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(reason)).otherwise(F.lit(None).cast("string"))
    return df.withColumn("reason", reason)


def class_label(label: Column) -> Column:
    """A label as a whole number; null where it isn't one."""
    return label.try_cast("int")


def media_one(path: Column) -> Column:
    """A single path as a list of one (bytes, path); null stays null."""
    return F.when(path.isNotNull(), F.array(F.struct(F.lit(None).cast("binary").alias("bytes"), path.alias("path"))))


def encoded(df: DataFrame, text: str, split: str = r"\s+") -> DataFrame:
    """`df` with `tokens` and `length`: the text cut at white space, which stands in for a tokenizer's encoding; none for a null."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), split), lambda w: w != "")
    return df.withColumn("tokens", words).withColumn("length", F.size("tokens").cast("bigint"))


def prepared(df: DataFrame) -> DataFrame:
    """`df` with `messages`, by the rules its column names ask for: messages as they are, instruction and input joined, or query and response."""
    df = renamed(df, ALIASES) if family_of(df.columns) == "response" else df
    there = lambda c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    kind = family_of(df.columns)
    if kind == "messages":
        name = next(c for c in df.columns if c.lower() in ("messages", "conversations", "conversation"))
        return df if name == "messages" else df.withColumnRenamed(name, "messages")
    history = there("history", "array<array<string>>")
    query, response = (joined_prompt(F.col("instruction"), F.col("input")), there("output")) if kind == "alpaca" else (there("query"), there("response"))
    return df.withColumn("messages", response_messages(there("system"), history, query, response))


def system_and_turns(messages: Column) -> tuple[Column, Column]:
    """(system, messages without it): a first system message is taken off, tool_response becomes tool."""
    first = F.try_element_at(messages, F.lit(1))
    there = F.coalesce(first["role"] == "system", F.lit(False))
    rest = F.when(there, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    return F.when(there, first["content"]), F.transform(rest, lambda m: _message_of(F.when(m["role"] == "tool_response", "tool").otherwise(m["role"]), m["content"]))


def _message_of(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def drawn_number(row: Column, seed: int, below: int) -> Column:
    """A number from 0 for each row id, drawn by md5, so that other engines draw the same."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(row.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint"), F.lit(below))


def language_pick(first: list[str], second: list[str], row: Column, seed: int = 0, share: float = 0.8) -> Column:
    """A prompt drawn from the first list in the given share of rows, else from the second, evenly within each."""
    one = lambda xs, s: F.get(F.array(*map(F.lit, xs)), drawn_number(row, s, len(xs)).cast("int"))
    return F.when(drawn_number(row, seed, 1000) < int(share * 1000), one(first, seed + 1)).otherwise(one(second, seed + 2))


def one_of(values: Column, row: Column, seed: int = 0) -> Column:
    """One element of an array, drawn by md5 of the row's id; null for an empty one."""
    return F.get(values, F.when(F.size(values) > 0, F.pmod(F.conv(F.substring(F.md5(F.concat(row.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint"), F.size(values)).cast("int")))


def query_and_response(df: DataFrame, query: str, response: str, keep: list[str] | None = None) -> DataFrame:
    """Two columns as query and response, beside those to keep."""
    return df.select(*(keep or []), F.col(query).alias("query"), F.col(response).alias("response"))


def kept_kinds(df: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """Rows of the named kinds; a null kind is none of them."""
    return df.where(F.col(column).isin(kinds))


def captioned(df: DataFrame, prompt: str, caption: Column, key: list[str]) -> DataFrame:
    """(key ..., messages) of a fixed question and each row's caption; rows without one are left out."""
    rows = df.withColumn("__c", caption).where(F.coalesce("__c", F.lit("")) != "")
    return rows.select(*key, F.array(_message("user", F.lit(prompt)), _message("assistant", F.col("__c"))).alias("messages"))
