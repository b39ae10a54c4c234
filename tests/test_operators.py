import os

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import registry
from quillgrid.operators import agents, datasets, groups, messages, metrics, packs, presets, rewards, rows
from quillgrid.sources import files
from quillgrid.streaming import stateful


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_rename_plan():
    plan = rows.rename_plan(["Query", "PROMPT", "image", "x"], {"query": "query", "prompt": "query", "image": "images", "X": "x"})
    assert plan == {"image": "images"}  # two want `query`, so neither; identities drop out
    assert rows.family_of(["Messages"]) == "messages" and rows.family_of(["instruction", "input"]) == "alpaca" and rows.family_of(["a"]) == "response"


def test_boxes_and_rounding(spark):
    box = lambda *v: F.array(*map(F.lit, v))
    got = one(spark, rows.ordered_box(box(5.0, 1.0, 2.0, 9.0)), rows.ordered_box(box(3.0)), messages.scaled_box(box(2.5, 1.0), F.lit(1000.0), F.lit(400.0)), messages.box_text(box(1, 2, 3, 4)))
    assert got == ([2.0, 1.0, 5.0, 9.0], None, [2, 2], "[(1,2),(3,4)]")


def test_delimiters_and_places(spark):
    text = F.lit("aaaAction:bb\nbAction Inputs:\nabbb")
    parts = messages.split_at(text, "Action:|Action Inputs:")
    got = one(spark, parts, messages.find_all(F.array(*map(F.lit, [1, 2, 1, 2, 1])), F.array(F.lit(1), F.lit(2))), messages.find_all(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))))
    assert [tuple(p) for p in got[0]] == [("", "aaa"), ("Action:", "bb\nb"), ("Action Inputs:", "\nabbb")]
    assert got[1:] == ([0, 2], [])


def test_messages_with_nulls(spark):
    df = spark.createDataFrame([(1, [("user", None), ("user", "a"), ("assistant", "b")]), (2, []), (3, None)], "id int, m array<struct<role:string,content:string>>")
    got = {r["id"]: tuple(r)[1:] for r in df.select("id", messages.merged_runs(F.col("m")), rows.valid_messages(F.col("m")), messages.pairs_of(F.col("m")), messages.role_lines(F.col("m"))).collect()}
    assert [tuple(x) for x in got[1][0]] == [("user", "\na"), ("assistant", "b")] and got[1][1] is False
    assert got[1][2] == [[None, "a"], ["b", None]] and got[1][3] == "User: a\nAssistant: b"
    assert got[2][0] == [] and got[2][1] is False and got[3][0] is None and got[3][1] is False


def test_truncation_sides(spark):
    ids = F.array(*map(F.lit, [1, 7, 2, 3, 7, 4]))
    got = one(spark, messages.truncated_ids(ids, 4, [7]), messages.truncated_ids(ids, 4, [7], "left"), messages.truncated_ids(ids, 1, [7]), messages.truncated_ids(ids, 9, [7]))
    assert got == ([1, 7, 2, 7], [7, 3, 7, 4], [7, 7], [1, 7, 2, 3, 7, 4])


def test_rewards(spark):
    t = "<think>a</think> <answer>b</answer>"
    got = one(spark, rewards.format_reward(F.lit(t)), rewards.format_reward(F.lit(t + "\n")), rewards.format_reward(F.lit(None).cast("string")), rewards.soft_overlong(F.lit(150), 200, 100), rewards.char_f1(F.lit("ERROR x"), F.lit("x")), rewards.repetition_penalty(F.lit("a a a a"), 2, -1.0))
    assert got == (1.0, 0.0, 0.0, -0.5, 0.0, pytest.approx(-2 / 3))
    assert rewards.evaluate("2*(3+4)-10/4") == 11.5 and rewards.evaluate("8-3-2") == 3 and rewards.evaluate("12/3/2") == 2
    assert rewards.evaluate("1/0") is None and rewards.evaluate("import os") is None and rewards.evaluate("2+") is None and rewards.evaluate("-(2)") == -2


def test_arrow_rewards(spark):
    df = spark.createDataFrame([("so \\boxed{\\frac{1}{2}}", "0.5", "<answer>(1+2)*3</answer>", 9, [1, 2, 3]), (None, "", "<answer>1+2</answer>", 9, [1, 2, 3])], "t string, g string, e string, goal int, n array<int>")
    assert [tuple(r) for r in df.select(rewards.math_reward("t", "g"), rewards.countdown_reward("e", "goal", "n")).collect()] == [(1.0, 1.0), (0.0, 0.0)]


def test_groups(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 5.0), (None, 1, 1.0)], "g string, i int, r double")
    got = {(r["g"], r["i"]): r["advantage"] for r in groups.advantages(df, ["g"], "r").collect()}
    assert got["a", 1] == pytest.approx(-1 / (2**0.5 + 1e-4)) and got["b", 1] is None and got[None, 1] is None
    miss = spark.createDataFrame([(None, float("nan")), (1.0, float("nan"))], "x double, y double")
    assert [tuple(r) for r in miss.select(groups.weighted_reward({"x": 1.0, "y": 1.0}), groups.all_missing(["x", "y"])).collect()] == [(0.0, True), (1.0, False)]
    assert groups.reward_metrics(df.limit(0), "g", "r").first()["reward"] is None
    tails = spark.createDataFrame([("a<nl>\n",), ("a",)], "t string")
    assert [tuple(r) for r in tails.select(groups.tail_rejected(F.col("t"), "<nl>"), groups.tail_rejected_intended(F.col("t"), "<nl>")).collect()] == [(False, True), (True, False)]


def test_row_numbers_and_samples(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    assert sorted((r["k"], r["rn"]) for r in packs.row_numbers(df, ["k"]).collect()) == [(k, k + 1) for k in range(1000)]
    assert datasets.sample_rows(df, "k", 2500).count() == 2500 and datasets.sample_rows(df.limit(0), "k", 5).count() == 0
    assert datasets.split_exact(df, "k", 0.123).where("is_val").count() == 123
    assert packs.batches(df, ["k"], 64, drop_last=True).count() == 960
    parts = [datasets.shard(df, ["k"], 3, i, False).count() for i in range(3)]
    assert sum(parts) == 1000 and max(parts) - min(parts) <= 1
    ranks = metrics.distributed_rank(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double"), "v")
    assert sorted(r["rank"] for r in ranks.collect()) == [1.0, 2.5, 2.5, 4.0]


def test_agents(spark):
    text = F.lit("Thought: x\nAction: find\nAction Input: {\"a\": 1}\nObservation: ok\nAction: stop\nAction Input: {}")
    calls, broken = one(spark, agents.react_calls(text), agents.hermes_calls(F.lit("<tool_call>{oops</tool_call>")))
    assert [tuple(c) for c in calls] == [("find", '{"a": 1}'), ("stop", "{}")] and broken[0]["name"] is None
    df = spark.createDataFrame([("{'a': 1}",), ("[{\"x\": 1}{\"y\": 2}]",), ("oops(",), (None,)], "t string")
    assert [r[0] for r in df.select(agents.repaired_json("t")).collect()] == ['{"a": 1}', '[{"x": 1}, {"y": 2}]', None, None]
    empty = one(spark, agents.keyword_scales(F.lit("<think>\n\n</think>\nyes"), "ignore_empty_think"))[0]
    assert [(p["text"], p["scale"]) for p in empty] == [("<think>\n\n</think>\n", 0.0), ("yes", 1.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("system,instruction,output\n,3.3,x\ns,,y\n")
    got = [tuple(r) for r in files.read_path(spark, str(tmp_path / "a.csv")).collect()]
    assert got == [("", "3.3", "x"), ("s", "", "y")]
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2, "b": "x"}]')
    assert files.read_path(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "v.jsonl").write_text('{"aaa": "bbb"}\n111\n[1.1]\n\n')
    assert files.read_json_values(spark, str(tmp_path / "v.jsonl")).where("value is not null").count() == 3
    (tmp_path / "list.txt").write_text("a.jpg\n\nb.png\n")
    assert files.image_paths(spark, str(tmp_path / "list.txt")).count() == 2
    os.makedirs(tmp_path / "img")
    for n in ("x.jpg", "y.png", "z.gif"):
        (tmp_path / "img" / n).write_bytes(b"1")
    assert files.image_paths(spark, str(tmp_path / "img")).count() == 2
    with pytest.raises(ValueError):
        files.read_path(spark, "a.xyz")


def test_dataset_names(spark, tmp_path):
    n = files.DatasetName.parse("hf::org/name:a/b#50")
    assert (n.hub, n.path, n.subsets, n.sample) == ("hf", "org/name", ["a", "b"], 50)
    odd = tmp_path / "x#3"
    odd.write_text("")
    assert files.DatasetName.parse(str(odd)).path == str(odd)
    reg = files.Registry()
    reg.register_json('[{"path": "org/name", "columns": {"q": "query"}, "subsets": {"a": {}, "w": {"weak": true}}}]')
    e = reg.find("other/name")
    assert e.columns == {"q": "query"} and reg.subsets(e, ["all"]) == ["a"] and reg.find("none") is None
    with pytest.raises(ValueError):
        reg.subsets(e, [])
    with pytest.raises(ValueError):
        reg.register("org/name", e)


def test_resumed_sink(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "k")
    p = str(tmp_path / "t")
    files.append_missing(df.where("k < 4"), p, "k")
    assert files.append_missing(df, p, "k") == 6 and files.append_missing(df, p, "k") == 0


def test_streams(spark, tmp_path):
    spark.range(200).select(F.lit(0).alias("shard"), "id", (F.col("id") % 30 + 1).cast("int").alias("n")).repartition(5).write.parquet(str(tmp_path / "in"))
    s = stateful.file_stream(spark, str(tmp_path / "in"), "shard int, id bigint, n int", files_per_batch=1)
    stateful.run_once(stateful.packed_stream(s, "shard", "id", "n", 40), str(tmp_path / "out"), str(tmp_path / "c"))
    out = spark.read.parquet(str(tmp_path / "out"))
    fill = out.groupBy("bin").agg(F.sum("n").alias("t"))
    assert out.count() == 200 and fill.agg(F.max("t")).first()[0] <= 40 and fill.count() <= 110
    s = stateful.file_stream(spark, str(tmp_path / "in"), "shard int, id bigint, n int")
    q = stateful.shuffled_batches(s, "id", 1, str(tmp_path / "mix"), str(tmp_path / "c2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "mix")).count() == 200


def test_registry(spark):
    registry.REWARDS.register("same", lambda a, b, weight=1.0: (a == b).cast("double") * weight)
    df = spark.createDataFrame([("x", "x")], "a string, b string")
    assert registry.scored(df, {"r": ("same", ["a", "b"])}, weight=2.0, other=1).first()["r"] == 2.0 and "format" in registry.REWARDS


def test_presets(spark):
    turns = presets.marked_turns(F.lit("\n\nHuman: a\n\nAssistant: b"))
    spans = lambda *s: F.array(*[F.struct(F.lit(a).alias("begin"), F.lit(b).alias("end")) for a, b in s])
    got = one(spark, turns, presets.marked_turns(F.lit("\n\nHuman: a\n\nHuman: b")), presets.overlapping(spans((3, 5), (0, 3))), presets.overlapping(spans((2, 5), (0, 3))), presets.letter(F.lit(2)))
    assert [tuple(t) for t in got[0]] == [("user", "a"), ("assistant", "b")] and got[1:] == (None, False, True, "C")


def test_rouge(spark):
    df = spark.createDataFrame([("a b c d", "a b c d"), ("", "x"), ("a b", "c d"), (None, "a")], "p string, t string")
    got = [r["m"] for r in df.select(metrics.rouge_bleu("p", "t").alias("m")).collect()]
    assert got[0]["rouge1"] == got[0]["rougel"] == 100.0 and got[0]["bleu4"] == pytest.approx(100.0) and got[1]["rouge1"] is None and got[2]["rouge2"] == 0.0 and got[3]["bleu4"] is None
