"""Rule rewards of a completion as columns; all stay in generated code but the marked Arrow functions."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .algebra import same_answer


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def format_reward(text: Column) -> Column:
    """1.0 for <think>...</think> <answer>...</answer> and nothing else; null counts as 0."""
    return _flag(text.rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>(?![\s\S])"))


def react_reward(text: Column) -> Column:
    """1.0 for a thought followed by an action and its input."""
    return _flag(text.rlike(r"(?sm)\A<think>.*?</think>\s*Action:.*?Action Input:.*?$"))


def repetition_penalty(text: Column, n: int, most: float) -> Column:
    """(1 - distinct / all n-grams) * most over lower-case words; texts of fewer words give 0."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.slice(words, i, n))
    share = 1.0 - F.size(F.array_distinct(grams)) / F.size(grams)
    return F.when(F.size(words) < n, 0.0).otherwise(share * most)


def soft_overlong(length: Column, most: int, cache: int) -> Column:
    """0 up to most - cache, then falling to -1 at most."""
    return F.least(-(length - (most - cache)) / cache, F.lit(0.0))


def cosine_reward(correct: Column, length: Column, most: int, wrong: tuple[float, float] = (-0.5, 0.0), right: tuple[float, float] = (1.0, 0.5)) -> Column:
    """Cosine from the first value of a pair at length 0 to the second at length `most`."""

    def curve(pair: tuple[float, float]) -> Column:
        low, high = pair[1], pair[0]
        return low + 0.5 * (high - low) * (1.0 + F.cos(F.lit(math.pi) * length / most))

    return F.when(correct, curve(right)).otherwise(curve(wrong))


def char_f1(pred: Column, truth: Column) -> Column:
    """F1 of the multisets of characters; 'ERROR...' and 'not answerable' give 0."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    common = F.aggregate(
        F.array_distinct(chars(truth)), F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.least(F.size(F.filter(chars(pred), lambda y: y == x)), F.size(F.filter(chars(truth), lambda y: y == x))),
    )
    total = F.char_length(pred) + F.char_length(truth)
    return F.when(pred.startswith("ERROR") | F.lower(pred).contains("not answerable") | (total == 0), 0.0).otherwise(2.0 * common / total)


def completion_gate(text: Column, markup: Column, most: int = 30_000) -> Column:
    """Markup that doesn't end in <nl> is 'ERROR'; other completions are cut at `most` characters."""
    stripped = F.regexp_replace(text, r"\s+$", "")
    return F.when(markup & ~stripped.endswith("<nl>"), "ERROR").otherwise(F.left(text, F.lit(most)))


def answer_match(text: Column, truth: Column) -> Column:
    """1.0 if the text of <answer>, or the whole text without one, is the truth, ends stripped."""
    inner = F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return _flag(strip(F.when(inner != "", inner).otherwise(text)) == strip(truth))


def code_format(text: Column, language: Column) -> Column:
    """1.0 for <think> followed by an answer with a fence of the language."""
    return _flag(F.regexp_like(text, F.concat(F.lit(r"(?s)\A<think>.*?</think>\s*<answer>.*?```"), language, F.lit(r".*?```.*?</answer>(?![\s\S])"))))


def last_fence(text: Column, language: str) -> Column:
    """Body of the last fence of a language; '' if none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s)```{language}\n(.*?)```"), F.lit(1)), F.lit(-1)), F.lit(""))


def verdict(text: Column) -> Column:
    """1.0 for [YES], 0.0 for any other bracketed word or none."""
    return _flag(F.regexp_extract(text, r"\[([A-Z]+)\]", 1) == "YES")


def stated_reward(text: Column) -> Column:
    """The number in [0, 1] after 'Reward:'; null if none."""
    return F.regexp_extract(text, r"Reward:\s*([0-1](?:\.\d+)?)", 1).try_cast("double")


def length_reward(text: Column, most_words: int) -> Column:
    return F.bround(F.least(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) / most_words, F.lit(1.0)), 2)


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Shared by all elements of two arrays, with counts; 1.0 if both are empty."""
    count = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    every = F.array_union(a, b)
    fold = lambda f: F.aggregate(every, F.lit(0), lambda acc, x: acc + f(count(a, x), count(b, x)))
    total = fold(F.greatest)
    return F.when(total == 0, 1.0).otherwise(fold(F.least) / total)


def last_action(text: Column) -> tuple[Column, Column]:
    """(action, input) of the last 'Action:' and 'Action Input:'; 'none' and '{}' without them."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    after = F.substring_index(text, "Action:", -1)
    action = F.when(text.contains("Action:"), strip(F.substring_index(after, "Action Input:", 1))).otherwise("none")
    given = F.when(text.contains("Action Input:"), strip(F.substring_index(text, "Action Input:", -1))).otherwise("{}")
    return action, given


def tool_reward(pred: Column, truth: Column) -> Column:
    """1.0 if the last action is the true one and its JSON input has the same keys and values.

    Half points for equal keys can't reach 1, and the score bands of inputs that aren't JSON
    lie above any score, so both give 0, as written.
    """
    clean = F.regexp_replace(pred, r"<\|endoftext\|>|<\|im_end\|>", "")
    clean = F.when(clean.endswith("Observation:"), F.substring_index(clean, "Observation:", 1)).otherwise(clean)
    (pa, pi), (ta, ti) = last_action(clean), last_action(truth)
    p, t = F.from_json(pi, "map<string,string>"), F.from_json(ti, "map<string,string>")
    same = (F.size(p) == F.size(t)) & F.forall(F.map_keys(t), lambda k: F.coalesce(F.try_element_at(p, k) == F.try_element_at(t, k), F.lit(False)))
    return _flag((pa == ta) & p.isNotNull() & t.isNotNull() & same)


def bands_by_step(value: Column, step: Column, at: int, before: tuple[float, float], after: tuple[float, float]) -> Column:
    """A 0-1 score stretched to a range that changes after a step."""
    span = lambda r: r[0] + value * (r[1] - r[0])
    return F.when(step > at, span(after)).otherwise(span(before))


def clean_latex(text: Column) -> Column:
    """Math delimiters off, ends stripped."""
    return F.regexp_replace(F.regexp_replace(text, r"\\[()\[\]]|\$", ""), r"^\s+|\s+$", "")


# ---- Arrow functions ----------------------------------------------------------------------
_NUMBER = re.compile(r"\d+(?:\.\d+)?|[()+\-*/]")


def evaluate(expression: str) -> float | None:
    """Value of + - * / and brackets over numbers; None for anything else or a division by 0."""
    text = expression.replace(" ", "")
    items = _NUMBER.findall(text)
    if "".join(items) != text or not items:
        return None
    at = 0

    def factor() -> float:
        nonlocal at
        t = items[at]
        at += 1
        if t == "(":
            v = total()
            if items[at] != ")":
                raise ValueError
            at += 1
            return v
        if t in "+-":
            return factor() * (1 if t == "+" else -1)
        return float(t)

    def product() -> float:
        nonlocal at
        v = factor()
        while at < len(items) and items[at] in "*/":
            times = items[at] == "*"
            at += 1
            v = v * factor() if times else v / factor()
        return v

    def total() -> float:
        nonlocal at
        v = product()
        while at < len(items) and items[at] in "+-":
            sign = 1 if items[at] == "+" else -1
            at += 1
            v += sign * product()
        return v

    def whole() -> float:
        v = total()
        if at != len(items):
            raise ValueError
        return v

    try:
        return whole()
    except (ValueError, IndexError, ZeroDivisionError, RecursionError):
        return None


@F.pandas_udf(T.DoubleType())
def calculator(expression: pd.Series) -> pd.Series:
    """Value of each arithmetic expression; null where it isn't one."""
    return expression.map(lambda e: None if e is None else evaluate(e)).astype("float64")


@F.pandas_udf(T.DoubleType())
def countdown_reward(text: pd.Series, target: pd.Series, numbers: pd.Series) -> pd.Series:
    """1.0 if the answer's expression uses each number once and gives the target."""

    def one(t: str | None, goal, nums) -> float:
        m = re.search(r"<answer>(.*?)</answer>", t or "", re.S)
        if not m:
            return 0.0
        e = m.group(1).strip().split("=")[0]
        used = sorted(int(x) for x in re.findall(r"\d+", e))
        v = evaluate(e) if re.fullmatch(r"[\d+\-*/().\s]+", e) and used == sorted(map(int, nums)) else None
        return float(v is not None and abs(v - goal) < 1e-5)

    return pd.Series([one(*x) for x in zip(text, target, numbers)], dtype="float64")


def _fraction(text: str) -> float | None:
    m = re.fullmatch(r"\\?frac\{(.+)\}\{(.+)\}", text)
    return evaluate(f"({m.group(1)})/({m.group(2)})") if m else evaluate(text.rstrip("%").replace(",", "")) if text else None


@F.pandas_udf(T.DoubleType())
def math_reward(text: pd.Series, truth: pd.Series) -> pd.Series:
    """1.0 if the last \\boxed{...} (or number) of a text and of the truth are equal as strings, numbers or expressions; no truth gives 0."""

    def answer(t: str | None) -> str:
        t = (t or "").split("# Answer")[-1]
        found = re.findall(r"\\boxed\{((?:[^{}]|\{[^{}]*\})+)\}", t) or re.findall(r"-?\d[\d,]*(?:\.\d+)?", t)
        return re.sub(r"\\[()\[\]]|\$|\s", "", found[-1]) if found else t.strip()

    def one(t, g) -> float:
        a, b = answer(t), answer(g)
        if not b:
            return 0.0
        x, y = _fraction(a), _fraction(b)
        return float(a == b or (x is not None and y is not None and abs(x - y) <= 1e-9 * max(1.0, abs(y))) or same_answer(a, b))

    return pd.Series([one(*x) for x in zip(text, truth)], dtype="float64")


def process_prompt(template: str, question: Column, answer: Column) -> Column:
    """A template with {query} and {ground_truth} filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{query}"), F.coalesce(question, F.lit(""))), F.lit("{ground_truth}"), F.coalesce(answer, F.lit("")))


def process_reward(text: Column) -> Column:
    """The number in [0, 1] after 'Reward:', marks of emphasis aside; null if none."""
    return stated_reward(F.replace(text, F.lit("*"), F.lit("")))


def verified_reward(text: Column, truth: Column) -> Column:
    """1.0 if the answers are equal as mathematics, or the content of <answer> is that of the truth's; else 0."""
    inner = lambda c: F.when(c.rlike("<answer>.*?</answer>"), F.regexp_extract(c, "<answer>(.*?)</answer>", 1)).otherwise(c)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.greatest(math_reward(text, truth), F.coalesce(_flag(strip(inner(text)) == strip(inner(truth))), F.lit(0.0)))
