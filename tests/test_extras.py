import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgrid import session as sessions
from quillgrid.functions import registry
from quillgrid.operators import agents, datasets, groups, markup, messages, metrics, presets, tables
from quillgrid.sources import files


def table_of(rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def test_teds_by_hand():
    one = table_of([["ab"]])
    assert markup.teds_both(one, table_of([["ac"]])) == (0.75, 1.0)  # half a cell of two nodes
    assert markup.teds_both(one, table_of([["ab"], ["cd"]])) == (0.5, 0.5)  # a row and a cell of four nodes
    assert markup.teds_both(table_of([["a", "b"]]), table_of([["b", "a"]]))[0] == pytest.approx(1 - 2 / 3)
    assert markup.teds_both("<table><tr><td colspan='2'>ab</td></tr></table>", one) == (0.5, 0.5)
    assert markup.teds_both("", one) == markup.teds_both(None, one) == (0.0, 0.0) and markup.teds_both("<table></table>", "<table></table>") == (1.0, 1.0)


def test_matched_ends_change_no_distance():
    rng = random.Random(3)
    for _ in range(60):
        a = [[rng.choice(["x", "yy", ""]) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 5))]
        b = [list(r) for r in a]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b))
            rng.choice([lambda: b.pop(k) if len(b) > 1 else None, lambda: b.insert(k, ["z"]), lambda: b[k].append("w"), lambda: b[k].__setitem__(0, "yz")])()
        (x, n), (y, m) = markup.table_tree(table_of(a)), markup.table_tree(table_of(b))
        assert markup.tree_distance(x, y) == pytest.approx(markup._forest_distance(x, y))
        assert markup.teds_both(table_of(a), table_of(b))[1] == pytest.approx(markup.teds(table_of(a), table_of(b), True))


def test_teds_reward(spark):
    cell, same = "<fcel>a<fcel>b<nl>\n<fcel>c<fcel>d<nl>\n", table_of([["a", "b"], ["c", "d"]])
    rows = [
        (0, cell, cell, 1.0), (1, f"<think>x</think><answer>{same}</answer>", cell, 1.0), (2, cell, "<table></table>", 0.0), (3, None, cell, 0.0), (4, "no table", cell, 0.0), (5, table_of([["a"]]), cell, 1 - 4 / 6),
        (6, "y" * 30_000 + same, cell, 0.0), (7, "<fcel>a<nl>\n", cell, 0.0),  # one line of markup loses its line end, and isn't read as markup, as written
    ]
    df = spark.createDataFrame(rows, "k int, c string, s string, want double")
    assert {r["k"]: round(r["got"], 9) for r in df.select("k", markup.teds_reward(F.col("c"), F.col("s")).alias("got")).collect()} == {k: round(w, 9) for k, _, _, w in rows}


def test_span_scores_of_values(spark):
    """Right, wrong and false spans of pairs of tables, against plain Python."""
    pairs = [
        ("<fcel>a<lcel><nl>\n<fcel>b<fcel>c<nl>\n", "<table><tr><td colspan='2'>a</td></tr><tr><td>b</td><td>c</td></tr></table>", (1.0, 0.0, 0.0)),
        ("<fcel>a<lcel><lcel><nl>\n<fcel>b<fcel>c<fcel>d<nl>\n", "<table><tr><td colspan='2'>a</td><td>x</td></tr><tr><td>b</td><td>c</td><td>d</td></tr></table>", (0.0, 0.25, 0.0)),
        ("<fcel>a<lcel><nl>\n<fcel>b<fcel>c<nl>\n", "<table><tr><td>a</td><td>x</td></tr><tr><td rowspan='2'>b</td><td>c</td></tr><tr><td>d</td></tr></table>", (0.0, 0.0, -0.75)),
    ]
    df = spark.createDataFrame([(k, o, h) for k, (o, h, _) in enumerate(pairs)], "k int, o string, h string")
    p = df.select("k", markup.td_paths(markup.normal_table_udf("o"))["cells"].alias("p"), markup.td_paths(markup.normal_table_udf("h"))["cells"].alias("t"))
    assert {r[0]: tuple(r[1:]) for r in p.select("k", *markup.span_scores(F.col("p"), F.col("t"))).collect()} == {k: w for k, (_, _, w) in enumerate(pairs)}


def test_cells_of_odd_values(spark):
    """The relational plan and the value parser agree on short rows, orphans and blocks."""
    values = ["<lcel><fcel>a<nl><ucel><nl>", "<fcel>a<lcel><nl><ucel><xcel><nl>", "<fcel>a<nl><fcel>b<fcel>c<fcel>d<nl>", "<xcel><nl>", "", "<fcel>a<fcel>b<nl><ucel><ucel><nl><ucel><fcel>c<nl>"]
    df = spark.createDataFrame(list(enumerate(values)), "k int, o string")
    got = {}
    for r in tables.relational_cells(df, "k", "o").collect():
        got.setdefault(r["k"], set()).add((r["r"], r["c"], r["row_span"], r["col_span"]))
    for r in df.select("k", tables.read_table(F.col("o")).alias("t")).collect():
        assert {(c["start_row_offset_idx"], c["start_col_offset_idx"], c["row_span"], c["col_span"]) for c in (r["t"]["cells"] or [])} == got.get(r["k"], set())


def test_paths(spark):
    """Deep trees, circles, missing parents, and more paths than a recursive query allows."""
    rows = [("deep", k, k - 1 if k else None, float(k % 7), k == 299) for k in range(300)] + [("ring", 1, 2, 1.0, True), ("ring", 2, 1, 1.0, True), ("lost", 5, 4, 1.0, True), ("one", 1, None, 3.0, True)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in groups.path_rewards(spark.createDataFrame(rows, "tree_id string, node_id int, parent_id int, process_reward double, terminated boolean")).collect()}
    assert got == {("deep", 299): (pytest.approx(sum(k % 7 for k in range(300)) / 300), 0.0), ("one", 1): (3.0, 3.0)}
    many = spark.range(1_200_000).select((F.col("id") / 3).cast("bigint").alias("tree_id"), (F.col("id") % 3).alias("node_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 - 1).alias("parent_id"), (F.col("id") % 3).cast("double").alias("process_reward"), F.lit(True).alias("terminated"))
    n, total = groups.path_rewards(many).agg(F.count("*"), F.sum("mean_reward")).first()
    assert n == 1_200_000 and total == pytest.approx(400_000 * 1.5)


def test_no_task_takes_all(spark, capsys):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("r", F.col("k") % 5 * 1.0).withColumn("g", F.col("k") % 100)
    for plan in (datasets.split_exact(df, "k", 0.5), datasets.sample_rows(df, "k", 700), groups.dynamic_sample(df, "g", "r", ["k"], 500)):
        plan.explain()
        text = capsys.readouterr().out
        assert "TakeOrdered" not in text and "Limit" not in text
    assert groups.path_rewards(spark.createDataFrame([], "tree_id int, node_id int, parent_id int, process_reward double, terminated boolean")).count() == 0


def test_draws_and_turns(spark):
    df = spark.range(40).withColumnRenamed("id", "k").withColumn("s", F.when(F.col("k") < 30, "a").when(F.col("k") < 39, "b").otherwise("c"))
    mixed = datasets.interleaved(df, "s", "k", {"a": 0.5, "b": 0.5}, stop="all").collect()
    assert sum(r["s"] == "a" for r in mixed) == 30 and sum(r["s"] == "b" for r in mixed) == 30 and {r["copy"] for r in mixed if r["s"] == "b"} == {0, 1, 2, 3}
    first = datasets.interleaved(df, "s", "k", {"a": 0.5, "b": 0.5}).collect()
    assert sum(r["s"] == "a" for r in first) == 9 == sum(r["s"] == "b" for r in first)
    assert datasets.interleaved(df.limit(0), "s", "k", {"a": 1.0}).count() == 0
    assert {r["turn"]: r["n"] for r in datasets.round_robin(df, ["k"], 3).groupBy("turn").agg(F.count("*").alias("n")).collect()} == {0: 14, 1: 13, 2: 13}
    with pytest.raises(ValueError):
        datasets.take_and_skip(df, ["k"], None, 0.5)
    assert datasets.take_and_skip(df, ["k"], 10, 0.25).where("is_val").count() == 2 and datasets.take_and_skip(df, ["k"], None, 1).where("is_val").count() == 40
    assert datasets.split_ratio(0.1, True, False) == 0.0 == datasets.split_ratio(0.1, False, True) and datasets.split_ratio(0.1, False, False) == 0.1
    hashed = df.withColumn("h", F.xxhash64("k"))
    want = sorted(r["h"] for r in hashed.collect())[:3]
    assert [r["h"] for r in datasets.hash_sample(hashed, "h", 3).collect()] == want


def test_refills(spark):
    rows = [(0, "a", 1, 1.0), (0, "a", 2, 1.0), (0, "b", 1, 1.0), (0, "b", 2, 2.0), (1, "c", 1, 0.0), (1, "c", 2, 5.0), (2, "d", 1, 0.0), (2, "d", 2, 5.0)]
    df = spark.createDataFrame(rows, "attempt int, g string, i int, r double").withColumn("s", F.lit("clash"))
    keys = lambda n, k: {(x["g"], x["i"]) for x in groups.dynamic_sample(df, "g", "r", ["g", "i"], n, "attempt", k).collect()}
    assert keys(4, 2) == {("b", 1), ("b", 2), ("c", 1), ("c", 2)}
    assert keys(4, 1) == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}  # too few: the first draw as it is


def test_arrow_files_and_names(spark, tmp_path):
    for k, form in enumerate((pa.ipc.new_file, pa.ipc.new_stream)):
        with form(str(tmp_path / f"{k}.arrow"), pa.schema([("a", pa.int64()), ("b", pa.string())])) as w:
            for part in range(2):
                w.write_batch(pa.record_batch([pa.array([10 * k + part, None]), pa.array(["x", None])], names=["a", "b"]))
    got = files.read_path(spark, str(tmp_path / "0.arrow"))
    assert got.columns == ["a", "b"] and sorted(r["a"] for r in got.where("a is not null").collect()) == [0, 1]
    assert files.read_arrow(spark, str(tmp_path)).count() == 8
    spark.range(10).write.parquet(str(tmp_path / "ten.parquet"))
    reg = files.Registry()
    assert reg.load(spark, f"{tmp_path}/ten.parquet#3").distinct().count() == 3 and reg.load(spark, f"{tmp_path}/ten.parquet#23").count() == 23


def test_shared_folder_of_a_cluster():
    class Fake:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        sessions.shared_dir(Fake)


def test_aligned_labels(spark):
    rows = [([1, 2, 9, 3, 9, 4], [-100, 2, 9, 3, 9, 4], [1, 2, 7, 7, 7, 3, 8, 4]), ([9, 5], [9, 5], [6, 6, 5]), ([5, 9], [5, 9], [5, 6, 6]), ([5, 1], [5, 1], [4]), (None, None, [1])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, ids array<bigint>, labels array<bigint>, new array<bigint>")
    got = {r["k"]: r["a"] for r in df.select("k", messages.aligned_labels("ids", "labels", "new", F.lit(9)).alias("a")).collect()}
    assert (got[0]["ids"], got[0]["labels"]) == ([1, 2, 7, 7, 7, 3, 8, 4], [-100, 2, -100, -100, -100, 3, -100, 4])
    assert got[1]["labels"] == [-100, -100, 5] and got[2]["labels"] == [5, -100, -100] and got[3]["ids"] is None and got[4]["ids"] is None


def test_rules_of_presets(spark):
    one = lambda *c: spark.range(1).select(*[x.alias(f"c{k}") for k, x in enumerate(c)]).first()
    q, r = one(presets.split_problem(F.lit("# Add two\n```python\nx\n```\n"), F.lit("why")))[0]
    assert q == "Add two\n" and r == "```python\nx\n```\n\nwhy"
    turns, bad, plain = one(*[presets.marked_history(F.lit(t), F.lit("User: and?"), F.lit("yes")) for t in ("User:aAssistent:b", "User:aUser:b", "")])
    assert [tuple(t) for t in turns] == [("user", "a"), ("assistant", "b"), ("user", "and?"), ("assistant", "yes")] and bad is None and len(plain) == 2
    assert one(messages.start_image(F.array(F.struct(F.lit("user").alias("role"), F.lit("draw<start-image>").alias("content")))))[0]["generate"]
    assert registry.CALLS.get("parameters")(F.lit("x")) is not None and set(agents.TOOL_PROMPTS) == {"hermes", "fenced"}
    loss, n = metrics.listwise_loss(spark.createDataFrame([(1, 0.0, 1), (1, 0.0, 0), (2, 9.0, 1), (3, 1.0, 0), (3, 2.0, 0)], "g int, z double, y int"), ["g"], "z", "y").first()
    assert loss == pytest.approx(0.693147, abs=1e-5) and n == 1
    with pytest.raises(Exception, match="too long"):
        messages.length_policy(spark.createDataFrame([([1, 2, 3],)], "ids array<int>"), "ids", 2, "raise").collect()


def test_safe_json_at_any_depth(spark):
    df = spark.sql("select named_struct('api_token', 'x', 'raw', cast('b' as binary), 'in', array(named_struct('my_token', 'y', 'n', 1))) as s, map('a_token', 'z', 'b', 'c') as m, cast(null as struct<raw: binary>) as e")
    assert files.safe_json(df).first()[0] == '{"s":{"raw":"<<<bytes>>>","in":[{"n":1}]},"m":{"a_token":null,"b":"c"}}'


def test_appending_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "sink")
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [files.append_missing(df.where("k < 6"), path, "k"), files.append_missing(df, path, "k"), files.append_missing(df, path, "k")] == [6, 4, 0]
    assert spark.read.parquet(path).count() == 10 and files.path_kind(spark, path) == "folder" and files.path_kind(spark, f"{path}/x") is None


def test_best_fit_bins():
    from quillgrid.operators.packs import best_fit

    rng = random.Random(2)
    for _ in range(50):
        lengths, capacity = [rng.randint(0, 12) for _ in range(rng.randint(0, 40))], 10
        bins, want = [], [0] * len(lengths)
        for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [(capacity - b, j) for j, b in enumerate(bins) if b + lengths[k] <= capacity]
            j = min(fits)[1] if fits else len(bins)
            if j == len(bins):
                bins.append(0)
            bins[j] += lengths[k]
            want[k] = j
        assert best_fit(lengths, capacity) == want


def test_answers():
    from quillgrid.operators.algebra import same_answer

    equal = [("x^2+2x+1", "(x+1)^2"), (r"\frac{1}{2}", "0.5"), (r"\sqrt{8}", r"2\sqrt{2}"), ("x=3", "3"), (r"\frac{x^2-1}{x-1}", "x+1"), ("(1, 2)", "(1.0,2)"), (r"\sin^2", r"\sin^2"), (r"2\pi r", r"\pi r \cdot 2"), ("1,234", "1234"), (r"\sin{x}", r"\cos{(\pi/2-x)}"), (r"2^{-1}", "1/2"), (r"\dfrac{a+b}{2}", "a/2+b/2"), ("-(-3)", "3")]
    other = [("x^2", "2x"), ("1/2", "1/3"), ("(1,2)", "(2,1)"), ("x+1", "x"), ("", "1"), (None, None), ("1/0", "1"), ("((", "1"), ("yes", "no"), (r"\sqrt{2}", "1.414"), ("a", "b")]
    assert [p for p in equal if not same_answer(*p)] == [] and [p for p in other if same_answer(*p)] == []
    assert not same_answer("(" * 3000 + "1", "1")


def test_verified_reward(spark):
    from quillgrid.operators import rewards

    rows = [(r"so \boxed{x(x+1)}", r"\boxed{x^2+x}", 1.0), ("<answer>north</answer>", "<answer> north</answer>", 1.0), (r"\boxed{2}", r"\boxed{3}", 0.0), ("north", None, 0.0), (None, "1", 0.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, g string, want double")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", rewards.verified_reward(F.col("t"), F.col("g"))).collect())
