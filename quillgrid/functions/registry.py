"""Named extension points: scalar and process rewards, metrics, row steps and loss scales."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import agents, metrics, presets, rewards, rows


class Named:
    """Functions by name; settings a function asks for in its signature are handed to it."""

    def __init__(self):
        self.items: dict[str, Callable] = {}

    def register(self, name: str, fn: Callable | None = None):
        if fn is None:
            return lambda f: self.register(name, f)
        self.items[name] = fn
        return fn

    def get(self, name: str, **settings) -> Callable:
        fn = self.items[name]
        wanted = {k: v for k, v in settings.items() if k in inspect.signature(fn).parameters}
        return lambda *columns: fn(*columns, **wanted)

    def __contains__(self, name: str) -> bool:
        return name in self.items


#: Scalar rewards over columns (completion first), process rewards, metrics over frames, row steps.
REWARDS, PROCESS_REWARDS, METRICS, STEPS = Named(), Named(), Named(), Named()
#: Readers of tool calls by dialect, prompts that list tools, loss scales, models that score texts, and rules of the next turn.
CALLS, TOOL_PROMPTS, SCALES, REWARD_MODELS, SCHEDULERS = Named(), Named(), Named(), Named(), Named()

for _n, _f in {
    "format": rewards.format_reward, "react_format": rewards.react_reward, "repetition": rewards.repetition_penalty, "soft_overlong": rewards.soft_overlong,
    "cosine": rewards.cosine_reward, "char_f1": rewards.char_f1, "answer": rewards.answer_match, "code_format": rewards.code_format, "math": rewards.math_reward, "countdown": rewards.countdown_reward, "verified": rewards.verified_reward,
}.items():
    REWARDS.register(_n, _f)
PROCESS_REWARDS.register("stated", rewards.stated_reward)
STEPS.register("standard_only", rows.standard_only)
STEPS.register("two_answers", presets.two_answers)
METRICS.register("mean", metrics.mean_metric)
METRICS.register("exact_match", metrics.exact_match)
METRICS.register("mean_of_squares", lambda df, column, group=None: metrics.Metric(lambda total, n: F.try_divide(total, n)).add_state("total", lambda x: F.sum(x * x)).add_state("n", F.count).over(df, [column], group))
for _n in agents.DIALECTS:
    CALLS.register(_n, lambda text, dialect=_n: agents.calls_of(text, dialect))
for _n in agents.TOOL_PROMPTS:
    TOOL_PROMPTS.register(_n, lambda tools, system, kind=_n: agents.listed_tools(tools, system, kind))
for _n in agents.DESCRIBED:
    TOOL_PROMPTS.register(_n, lambda tools, system, kind=_n: agents.described_tools(agents.tool_parts(tools), system, kind))
for _n in agents.SCALES:
    SCALES.register(_n, lambda text, scale=_n: agents.keyword_scales(text, scale))
SCHEDULERS.register("until_answer", lambda text, turn, most=8: (turn < most) & ~F.contains(text, F.lit("</answer>")))


def scored(df: DataFrame, specs: dict[str, tuple[str, list[str | Column]]], **settings) -> DataFrame:
    """`df` with a column for each named reward: output name -> (reward, its columns)."""
    return df.withColumns({out: REWARDS.get(name, **settings)(*[F.col(c) if isinstance(c, str) else c for c in cols]) for out, (name, cols) in specs.items()})


def with_extra(df: DataFrame, name: str, out: str, columns: list[str], **settings) -> DataFrame:
    """`df` with a reward and, beside it, what else it gives: a reward of struct<value, extra> becomes `out` and `out_extra`, a plain one has a null extra."""
    value = REWARDS.get(name, **settings)(*map(F.col, columns))
    got = df.withColumn("__v", value)
    pair = got.schema["__v"].dataType.typeName() == "struct"
    return got.withColumns({out: F.col("__v.value") if pair else F.col("__v"), f"{out}_extra": F.col("__v.extra") if pair else F.lit(None).cast("string")}).drop("__v")


REWARDS.register("length_with_trace", lambda text: F.struct(F.least(F.length(text) / 1000.0, F.lit(1.0)).alias("value"), F.concat(F.length(text).cast("string"), F.lit(" characters")).alias("extra")))


def reward_model(load: Callable[[], object], score: Callable[[object, str], float]):
    """A column function of a text by a model that `load` makes once for each task; null texts have no score."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield texts.map(lambda t: float(score(model, t)), na_action="ignore").astype("float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def _vowels() -> frozenset[str]:
    return frozenset("aeiou")


REWARD_MODELS.register("vowel_share", lambda text: reward_model(_vowels, lambda model, t: sum(c in model for c in t.lower()) / max(len(t), 1))(text))


def load_plugins(spark, path: str) -> None:
    """A Python file of own registrations, shipped to the executors as well."""
    import importlib.util

    spark.sparkContext.addPyFile(path)
    spec = importlib.util.spec_from_file_location(path.rsplit("/", 1)[-1].removesuffix(".py"), path)
    spec.loader.exec_module(importlib.util.module_from_spec(spec))
