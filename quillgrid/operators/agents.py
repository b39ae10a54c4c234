"""Tool calls in several dialects, tool prompts, and loss weights by keyword."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .messages import split_at

CALLS = "array<struct<name:string,arguments:string>>"
#: Keyword weights of the named scales; a pair weighs a keyword and what follows it.
_PLAIN = {"Thought:": [1.0, 1.0], "Final Answer:": [1.0, 1.0], "Observation:": [2.0, 0.0]}
_REACT = {"Action:": [2.0, 2.0], "Action Input:": [2.0, 2.0], **_PLAIN}
_FLAN = ["Name:", "Action:", "ACTION:", "Tool:", "Command", "Arguments:", "action input", "ACTION_INPUT:", "Action Input:"]
_EMPTY_THINK = {
    r"<think>\s*</think>\s*": [0.0],
    r"<seed:think><seed:cot_budget_reflect>The current thinking budget is 0, so I will directly start answering the question.</seed:cot_budget_reflect>\n\n</seed:think>\s*": [0.0],
}
SCALES = {
    "react": _REACT,
    "alpha_umi": _REACT,  # its sixth entry has three numbers and is inert, as written
    "agentflan": {**dict.fromkeys(_FLAN, [1.0, 3.0]), **_PLAIN},
    "ignore_empty_think": _EMPTY_THINK,
    "hermes": {r"<tool_call>.+?</tool_call>": [2.0]},
    "qwen": {"✿FUNCTION✿:": [2.0, 2.0], "✿ARGS✿:": [2.0, 2.0], "✿RETURN✿:": [1.0, 1.0], "✿RESULT✿:": [2.0, 0.0]},
}
#: A reply to a query with one of these weighs so much as a whole.
QUERY_SCALES = {"agentflan": {"What is the tool you want to use": 3.0, "What are the required parameter names": 3.0, "What is the value of": 3.0, "What are the required parameter names for this tool": 3.0}}


def react_calls(text: Column) -> Column:
    """Pairs of 'Action:' and 'Action Input:' as calls."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)Action:\s*(.*?)\s*Action Input:\s*(.*?)(?=\s*(?:Action:|Observation:|$(?![\s\S])))"), F.lit(0))
    name = lambda c: F.regexp_extract(c, r"(?s)Action:\s*(.*?)\s*Action Input:", 1)
    args = lambda c: F.regexp_extract(c, r"(?s)Action Input:\s*(.*?)\s*$", 1)
    return F.transform(found, lambda c: F.struct(name(c).alias("name"), args(c).alias("arguments")))


def hermes_calls(text: Column) -> Column:
    """JSON calls in <tool_call> tags; broken JSON gives null names."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.+?)\s*</tool_call>"), F.lit(1))
    return F.transform(found, lambda c: F.struct(F.get_json_object(c, "$.name").alias("name"), F.coalesce(F.get_json_object(c, "$.arguments"), F.get_json_object(c, "$.parameters")).alias("arguments")))


def glm_calls(text: Column) -> Column:
    """A name line followed by a JSON object."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z_]\w*)\n(\{.*\})"), F.lit(0))
    return F.transform(found, lambda c: F.struct(F.substring_index(c, "\n", 1).alias("name"), F.regexp_extract(c, r"\n(\{.*\})", 1).alias("arguments")))


def key_value_call(text: Column) -> Column:
    """<arg_key>/<arg_value> pairs as a map."""
    keys = F.regexp_extract_all(text, F.lit(r"(?s)<arg_key>(.*?)</arg_key>"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r"(?s)<arg_value>(.*?)</arg_value>"), F.lit(1))
    return F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"].isNotNull()))


def coder_call(text: Column) -> Column:
    """<function=name> with <parameter=key> blocks: (name, map of parameters)."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<parameter=([^>]+)>\n?(.*?)\n?</parameter>"), F.lit(0))
    entry = lambda b: F.struct(F.regexp_extract(b, r"<parameter=([^>]+)>", 1), F.regexp_extract(b, r"(?s)<parameter=[^>]+>\n?(.*?)\n?</parameter>", 1))
    return F.struct(F.regexp_extract(text, r"<function=([^>]+)>", 1).alias("name"), F.map_from_entries(F.transform(blocks, entry)).alias("arguments"))


def fenced_calls(text: Column) -> Column:
    """<tool_call>name, then the arguments in a JSON fence."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.+?)\n```json(.+?)```</tool_call>"), F.lit(0))
    part = lambda c, k: F.trim(F.regexp_extract(c, r"(?s)<tool_call>(.+?)\n```json\s*(.+?)\s*```</tool_call>", k))
    return F.transform(found, lambda c: F.struct(part(c, 1).alias("name"), part(c, 2).alias("arguments")))


def parameter_calls(text: Column, end: str = "<|eom_id|>") -> Column:
    """Bare JSON objects with a name and parameters; an end token is taken off, others aren't calls."""
    body = F.when(text.endswith(end), F.left(text, F.length(text) - len(end))).otherwise(text)
    found = F.regexp_extract_all(body, F.lit(r'(?s)\{[^{]*?"name":.*?"parameters":\s*?\{.*?\}\s*?\}'), F.lit(0))
    calls = F.transform(found, lambda c: F.struct(F.get_json_object(c, "$.name").alias("name"), F.get_json_object(c, "$.parameters").alias("arguments")))
    return F.filter(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def delimited_calls(text: Column, begin: str = "<｜tool▁call▁begin｜>", sep: str = "<｜tool▁sep｜>", end: str = "<｜tool▁call▁end｜>") -> Column:
    """A name and its JSON arguments between begin, separator and end tokens; broken arguments are no call."""
    found = F.regexp_extract_all(text, F.lit(f"(?s){begin}(.*?){sep}(.*?){end}"), F.lit(0))
    part = lambda c, k: F.trim(F.regexp_extract(c, f"(?s){begin}(.*?){sep}(.*?){end}", k))
    return F.filter(F.transform(found, lambda c: F.struct(part(c, 1).alias("name"), part(c, 2).alias("arguments"))), lambda c: F.try_parse_json(c["arguments"]).isNotNull())


def calls_of(text: Column, dialect: str) -> Column:
    """Calls in a named dialect; where there is none, those in the Action form."""
    found = DIALECTS[dialect](text)
    return F.when(F.size(F.coalesce(found, F.array().cast(CALLS))) > 0, found).otherwise(react_calls(text))


#: Readers of calls by dialect.
DIALECTS = {"react": react_calls, "hermes": hermes_calls, "fenced": fenced_calls, "glm": glm_calls, "parameters": parameter_calls, "delimited": delimited_calls}
#: Heads and tails of prompts that list tools, one definition in JSON a line.
TOOL_PROMPTS = {
    "hermes": (
        "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>\n",
        "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n"
        '<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>',
    ),
    "fenced": (
        "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>\n",
        "\n</tools>\n\nFor function call returns, you should first print <tool_calls>For each function call, you should return object like:\n"
        "<tool_call>function_name\n```json\nfunction_arguments_in_json_format\n```</tool_call>At the end of function call returns, you should print </tool_calls>",
    ),
}


#: A tool's description, head and tail of prompts that describe tools; %s in a tail are the names.
_TOOL_EN = "### {human}\n\n{name}: {description} Parameters: {parameters} Format the arguments as a JSON object."
_TOOL_ZH = "### {human}\n\n{name}: {description} 输入参数：{parameters} 此工具的输入应为JSON对象。"
_HEAD_EN, _HEAD_ZH = "\n\n# Tools\n\n## You have access to the following tools:\n\n", "\n\n# 工具\n\n## 你拥有如下工具：\n\n"
DESCRIBED = {
    "marked_en": (
        _TOOL_EN, _HEAD_EN,
        "\n\n## When you need to call a tool, please insert the following command in your reply, which can be called zero or multiple times according to your needs:\n\n"
        "✿FUNCTION✿: The tool to use, should be one of [%s]\n✿ARGS✿: The input of the tool\n✿RESULT✿: Tool results\n✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)",
    ),
    "marked_zh": (
        _TOOL_ZH, _HEAD_ZH,
        "\n\n## 你可以在回复中插入零次、一次或多次以下命令以调用工具：\n\n✿FUNCTION✿: 工具名称，必须是[%s]之一。\n✿ARGS✿: 工具输入\n✿RESULT✿: 工具结果\n✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来",
    ),
    "parallel_en": (
        _TOOL_EN, _HEAD_EN,
        "\n\n## Insert the following command in your reply when you need to call N tools in parallel:\n\n✿FUNCTION✿: The name of tool 1, should be one of [%s]\n✿ARGS✿: The input of tool 1\n✿FUNCTION✿: The name of tool 2\n✿ARGS✿: The input of tool 2\n...\n"
        "✿FUNCTION✿: The name of tool N\n✿ARGS✿: The input of tool N\n✿RESULT✿: The result of tool 1\n✿RESULT✿: The result of tool 2\n...\n✿RESULT✿: he result of tool N\n✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)",
    ),
    "parallel_zh": (
        _TOOL_ZH, _HEAD_ZH,
        "\n\n## 你可以在回复中插入以下命令以并行调用N个工具：\n\n✿FUNCTION✿: 工具1的名称，必须是[%s]之一\n✿ARGS✿: 工具1的输入\n✿FUNCTION✿: 工具2的名称\n✿ARGS✿: 工具2的输入\n...\n✿FUNCTION✿: 工具N的名称\n✿ARGS✿: 工具N的输入\n"
        "✿RESULT✿: 工具1的结果\n✿RESULT✿: 工具2的结果\n...\n✿RESULT✿: 工具N的结果\n✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来",
    ),
    "react_en": (
        "{name}: Call this tool to interact with the {human} API. What is the {human} API useful for? {description} Parameters: {parameters} Format the arguments as a JSON object.",
        "Answer the following questions as best you can. You have access to the following tools:\n\n",
        "\n\nUse the following format:\n\nQuestion: the input question you must answer\nThought: you should always think about what to do\nAction: the action to take, should be one of [%s]\nAction Input: the input to the action\n"
        "Observation: the result of the action\n... (this Thought/Action/Action Input/Observation can be repeated zero or more times)\nThought: I now know the final answer\nFinal Answer: the final answer to the original input question\n\nBegin!\n",
    ),
}


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "human", "description", "parameters")])))
def tool_parts(tools: pd.Series) -> pd.Series:
    """Names, description and parameters of the JSON definitions of a list; a definition without a name or description is null."""

    def one(text):
        tool = json.loads(text)
        tool = tool["function"] if "type" in tool and "function" in tool else tool
        name, description = tool.get("name_for_model") or tool.get("name"), tool.get("description", tool.get("description_for_model"))
        if name is None or description is None:
            return None
        parameters = tool.get("parameters") or {}
        return {"name": name, "human": tool.get("name_for_human") or name, "description": description, "parameters": parameters if isinstance(parameters, str) else json.dumps(parameters, ensure_ascii=False)}

    return tools.map(lambda ts: [one(t) for t in ts], na_action="ignore")


def described_tools(parts: Column, system: Column, kind: str) -> Column:
    """A prompt that describes tools, from the result of `tool_parts`, in a named form; the system text stands first, but in the Action form."""
    item, head, tail = DESCRIBED[kind]

    def text(p: Column) -> Column:
        out = F.lit(item)
        for n in ("name", "human", "description", "parameters"):
            out = F.replace(out, F.lit("{%s}" % n), p[n])
        return out

    names = F.array_join(F.transform(parts, lambda p: p["name"]), ",")
    before = F.lit("") if kind == "react_en" else F.coalesce(system, F.lit(""))
    return F.concat(before, F.lit(head), F.array_join(F.transform(parts, text), "\n\n"), F.replace(F.lit(tail), F.lit("%s"), names))


def listed_tools(tools: Column, system: Column, kind: str) -> Column:
    """A system prompt followed by the tools of an array of JSON definitions, in a named form."""
    head, tail = TOOL_PROMPTS[kind]
    before = F.when(F.coalesce(system, F.lit("")) != "", F.concat(system, F.lit("\n\n"))).otherwise("")
    return F.concat(before, F.lit(head), F.array_join(F.transform(tools, wrapped_tool), "\n"), F.lit(tail))


def calls_as_messages(calls: Column) -> Column:
    """A JSON list of calls as one tool_call message each; broken JSON gives null."""
    parsed = F.from_json(calls, "array<string>")
    return F.transform(parsed, lambda c: F.struct(F.lit("tool_call").alias("role"), c.alias("content")))


def wrapped_tool(tool: Column) -> Column:
    """A tool definition under `function`; one that has it already stays."""
    there = F.get_json_object(tool, "$.function").isNotNull()
    return F.when(there, tool).otherwise(F.concat(F.lit('{"type":"function","function":'), tool, F.lit("}")))


def unwrapped_tool(tool: Column) -> Column:
    return F.coalesce(F.get_json_object(tool, "$.function"), tool)


def bracket_calls(text: Column, begin: str = "[TOOL_CALLS]") -> Column:
    """A JSON list of calls after a marker."""
    body = F.substring_index(text, begin, -1)
    return F.when(text.contains(begin), F.from_json(body, CALLS))


def tool_prompt(names: Column, descriptions: Column, head: str = "You may call one or more functions.\n", item: str = "%s: %s") -> Column:
    return F.concat(F.lit(head), F.array_join(F.zip_with(names, descriptions, lambda n, d: F.format_string(item, n, d)), "\n"))


def observations(contents: Column) -> Column:
    """Tool replies as lines after 'Observation:'."""
    return F.array_join(F.transform(contents, lambda c: F.concat(F.lit("Observation:"), c)), "\n")


def react_lines(calls: Column) -> Column:
    return F.array_join(F.transform(calls, lambda c: F.concat(F.lit("Action: "), c["name"], F.lit("\nAction Input: "), c["arguments"])), "\n")


def keyword_scales(text: Column, scale: str) -> Column:
    """array<struct<text, scale>> of a reply by a named scale; without a keyword all of it weighs 1."""
    table = SCALES[scale]
    if all(len(v) == 1 for v in table.values()):
        pattern = "|".join(f"(?:{k})" for k in table)
        keys, rest = F.regexp_extract_all(text, F.lit(f"(?s)({pattern})"), F.lit(1)), F.split(text, f"(?s)(?:{pattern})")
        weight = F.lit(float(next(iter(table.values()))[0]))
        pairs = F.flatten(F.transform(rest, lambda t, i: F.array(F.struct(t.alias("text"), F.lit(1.0).alias("scale")), F.struct(F.get(keys, i).alias("text"), weight.alias("scale")))))
        return F.filter(pairs, lambda p: F.coalesce(p["text"], F.lit("")) != "")
    ordered = sorted(table, key=len, reverse=True)
    parts = split_at(text, "|".join(k.replace("(", r"\(") for k in ordered))
    pick = lambda key, j: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k in ordered for x in (k, float(table[k][j]))]), key), F.lit(1.0))
    both = F.flatten(F.transform(parts, lambda p: F.array(F.struct(p["key"].alias("text"), pick(p["key"], 0).alias("scale")), F.struct(p["content"].alias("text"), pick(p["key"], 1).alias("scale")))))
    return F.filter(both, lambda p: p["text"] != "")


def reply_scales(reply: Column, query: Column, scale: str) -> Column:
    """keyword_scales of a reply, cut short where the query holds a keyword of the scale."""
    out = keyword_scales(reply, scale)
    for word, weight in QUERY_SCALES.get(scale, {}).items():
        out = F.when(F.contains(query, F.lit(word)), F.array(F.struct(reply.alias("text"), F.lit(weight).alias("scale")))).otherwise(out)
    return out


def last_round_scales(messages: Column) -> Column:
    """array<array<struct<text, scale>>>: only the last assistant message weighs, its empty thought doesn't."""
    n = F.size(messages)
    pieces = lambda m: keyword_scales(m["content"], "ignore_empty_think")
    none = lambda m: F.array(F.struct(m["content"].alias("text"), F.lit(0.0).alias("scale")))
    return F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & (i == n - 1), pieces(m)).otherwise(none(m)))


def context_scales(messages: Column, kind: str = "default") -> Column:
    """Loss weight of each message: 'default' assistants, 'last_round' the last assistant, 'all' every one."""
    n = F.size(messages)
    if kind == "all":
        return F.transform(messages, lambda m: F.lit(1.0))
    last = (lambda i: i == n - 1) if kind == "last_round" else (lambda i: F.lit(True))
    return F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & last(i), 1.0).otherwise(0.0))


@F.pandas_udf(T.StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """JSON or a Python literal as JSON; touching objects in a list are parted; null if neither can be read."""

    def one(t):
        if t is None:
            return None
        for candidate in (t, t.replace("}{", "},{").replace("}\n{", "},{")):
            for read in (json.loads, ast.literal_eval):
                try:
                    return json.dumps(read(candidate), ensure_ascii=False)
                except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                    pass
        return None

    return text.map(one)
