"""Row rules of public dataset families as expressions: prompts, repairs, flat maps and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .messages import split_at
from .packs import running_sum

#: Fixed values.
INPUT_PREFIX, ANSWER_PREFIX = "输入：", "Answer: "


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.char_length(text))).otherwise(text)


def titled(title: Column, abstract: Column) -> Column:
    """Title and, where it differs, abstract; what follows the first 'n.' mark."""
    both = F.when(abstract.isNotNull() & (abstract != title), F.concat(title, F.lit("，"), abstract)).otherwise(title)
    after = F.regexp_extract(both, r"(?s)\d+[.,\s、](.+)", 1)
    return F.when(after != "", after).otherwise(both)


def mentions(messages: Column, words: list[str]) -> Column:
    """Some message holds one of the words, in any case."""
    return F.exists(messages, lambda m: F.coalesce(F.lower(m["content"]).rlike("|".join(words)), F.lit(False)))


def several_tools(messages: Column, pattern: str) -> Column:
    """A system message first that names two or more different tools."""
    first = F.try_element_at(messages, F.lit(1))
    return (first["role"] == "system") & (F.size(F.array_distinct(F.regexp_extract_all(first["content"], F.lit(pattern), F.lit(1)))) > 1)


def sql_prompt(schema: Column, question: Column) -> Column:
    return F.concat(F.lit("Here is a schema:\n"), schema, F.lit("\nWrite a query that answers: "), question)


def similarity_rows(df: DataFrame, a: str, b: str, score: str, least: float | None = None) -> DataFrame:
    """Pairs as messages with their score as text '%.1f'; optionally only those of a score at least."""
    rows = df if least is None else df.where(F.col(score) >= least)
    return rows.withColumn("label", F.format_string("%.1f", F.col(score).cast("double"))).withColumn("pair", F.array(a, b))


def two_answers(df: DataFrame, key: str, human: Column, model: Column) -> DataFrame:
    """Two rows for each: the human and the model answer with labels 0 and 1."""
    both = F.array(F.struct(F.lit(0).alias("label"), human.alias("answer")), F.struct(F.lit(1).alias("label"), model.alias("answer")))
    return df.select(key, F.inline(both))


def two_parts(text: Column, sep: str) -> Column:
    """Both parts of a text with exactly one separator; null for others."""
    p = F.split(text, sep)
    return F.when(F.size(p) == 2, p)


def marked_turns(text: Column) -> Column:
    """'Human:' and 'Assistant:' turns as messages; turns that don't alternate give null."""
    keys = F.regexp_extract_all(text, F.lit(r"(?:^|\n\n)(Human|Assistant):"), F.lit(1))
    parts = F.transform(F.slice(F.split(text, r"(?:^|\n\n)(?:Human|Assistant):"), 2, 1_000_000), lambda p: F.trim(p))
    role = lambda k: F.when(k == "Human", "user").otherwise("assistant")
    turns = F.zip_with(keys, parts, lambda k, p: F.struct(role(k).alias("role"), p.alias("content")))
    good = F.forall(F.transform(keys, lambda k, i: k == F.when(i % 2 == 0, "Human").otherwise("Assistant")), lambda x: x)
    return F.when(good, turns)


def named(text: Column, name: str, author: str) -> Column:
    return F.replace(F.replace(text, F.lit("{{NAME}}"), F.lit(name)), F.lit("{{AUTHOR}}"), F.lit(author))


def existing(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """Rows whose path is in a file listing. Left to the optimizer: broadcast where small, by hash where not."""
    return df.join(files.select(F.col("path").alias(path)).distinct(), path, "left_semi")


def sessions(df: DataFrame, user: list[str], order: list[str], starts: Column) -> DataFrame:
    """`df` with `session`: a row that starts one begins the next number within its user. Hot users are split."""
    return running_sum(df, user, order, F.coalesce(starts, F.lit(False)).cast("bigint"), "session")


def overlapping(spans: Column) -> Column:
    """Whether sorted [begin, end) spans overlap anywhere."""
    s = F.array_sort(spans)
    return F.exists(F.transform(s, lambda x, i: F.coalesce(F.get(s, i + 1)["begin"] < x["end"], F.lit(False))), lambda x: x)


def rounded_box(box: Column) -> Column:
    """Coordinates rounded half to even."""
    return F.transform(box, lambda v: F.bround(v, 0).cast("bigint"))


def object_lines(ids: Column, names: list[str]) -> Column:
    """One tag line for each object: category names by 0-based ids."""
    table = F.array(*map(F.lit, names))
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<ref-object>"), F.coalesce(F.get(table, i), F.lit("?")), F.lit("<bbox>"))), "\n")


def first_of(text: Column, sep: str) -> Column:
    return F.substring_index(text, sep, 1)


def letter(index: Column) -> Column:
    """A to E for 0 to 4."""
    return F.translate(index.cast("string"), "01234", "ABCDE")


def without_mark(text: Column) -> Column:
    """Without variation selectors."""
    return F.replace(text, F.lit("️"), F.lit(""))


def parts_text(parts: Column) -> Column:
    """Content parts of (type, text) as one text, other types as <image>."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).otherwise("<image>")), "")


def moved_path(path: Column, moves: dict[str, str]) -> Column:
    """A path with the first prefix that it holds replaced."""
    out = path
    for old, new in reversed(list(moves.items())):
        out = F.when(path.contains(old), F.replace(path, F.lit(old), F.lit(new))).otherwise(out)
    return out


def countdown_prompt(numbers: Column, target: Column) -> Column:
    return F.concat(F.lit("Using the numbers ["), F.array_join(numbers.cast("array<string>"), ", "), F.lit("], create an equation that equals "), target.cast("string"), F.lit("."))


def folded_history(system: Column, history: Column) -> Column:
    """History pairs as lines under the system text."""
    lines = F.transform(history, lambda h: F.concat_ws("\n", F.get(h, F.lit(0)), F.get(h, F.lit(1))))
    return F.concat_ws("\n", F.nullif(system, F.lit("")), F.array_join(lines, "\n"))


def chosen_option(options: Column, answer: Column) -> Column:
    """The option at a 0-based answer; null beyond the options."""
    return F.get(options, answer)


def first_named(*values: Column) -> Column:
    """The first value that is neither null nor 'None'."""
    return F.coalesce(*[F.nullif(v, F.lit("None")) for v in values])


def listed(value: Column) -> Column:
    """A scalar as a list of one; null stays null."""
    return F.when(value.isNotNull(), F.array(value))


def tail_after(text: Column, marker: str) -> Column:
    return F.when(text.contains(marker), F.substring_index(text, marker, -1)).otherwise(text)


def law_text(kind: Column, title: Column, chapters: list[Column], response: Column) -> Column:
    """Kind and title on lines of their own, then the chapters there are and the response."""
    return F.concat(kind, F.lit("\n"), title, F.lit("\n"), F.concat_ws("", *chapters), response)


def split_problem(text: Column, explanation: Column) -> Column:
    """(query, response): the problem before the first Python fence without its '# ', and the code with the explanation."""
    at = F.locate("```python", text)
    problem = F.when(at > 0, F.left(text, at - 1)).otherwise(F.left(text, F.length(text) - 1))  # without a fence the last character is taken for it, as written
    code = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(F.right(text, F.lit(1)))
    trimmed = F.regexp_replace(code, r"^\s+|\s+$", "")
    return F.struct(F.when(problem.startswith("# "), F.substring(problem, 3, F.length(problem))).otherwise(problem).alias("query"), F.concat(trimmed, F.lit("\n\n"), explanation).alias("response"))


#: What begins a turn, as written in the data.
TURN_MARKS = ["User:", "User：", "Assistant：", "Assistant:", "Asssistent:", "Assistent:", "Assistenz:"]


def marked_history(instruction: Column, question: Column, output: Column) -> Column:
    """Turns of a marked text, the question and the output as messages; null where turns don't alternate or one is empty."""
    parts = split_at(instruction, "|".join(TURN_MARKS))
    roles = F.transform(parts, lambda p, i: F.lower(p["key"]).contains(F.when(i % 2 == 0, "user").otherwise("ass")))
    sound = F.forall(roles, lambda r: r) & (F.size(parts) % 2 == 0) & F.forall(parts, lambda p: p["content"] != "")
    turns = F.transform(parts, lambda p, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), p["content"].alias("content")))
    asked = F.when(question.startswith("User:"), F.regexp_replace(F.substring(question, 6, F.length(question)), r"^\s+|\s+$", "")).otherwise(question)
    last = F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")), F.struct(F.lit("assistant").alias("role"), output.alias("content")))
    return F.when(F.coalesce(instruction, F.lit("")) == "", last).when(sound, F.concat(turns, last))
