import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.operators import tables
from quillgrid.operators.markup import levenshtein, normal_table, normalize_html, table_tree, teds, tree_distance
from quillgrid.operators.tables import Grid, to_html

#: Own goldens of the realignment rules.
GOLDEN = [
    ("<fcel>a<fcel>b<nl>\n<fcel>c<ecel><nl>\n", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td></td></tr></table>"),
    ("note<fcel>a<nl>\n<fcel>b<nl>\n", "<table><tr><td></td></tr><tr><td></td></tr></table>"),  # text before the first tag blocks all
    ("<fcel>a<nl>\n<nl>\n<fcel>b<nl>\n<fcel>c<nl>\n", "<table><tr><td>a</td></tr><tr><td></td></tr><tr><td>b</td></tr></table>"),  # a doubled end shifts texts
    ("<ecel>x<lcel><fcel>b<nl>\n", "<table><tr><td></td><td></td><td>b</td></tr></table>"),  # a text after an empty cell hides its span
    ("<ecel><lcel><fcel>b<nl>\n", '<table><tr><td colspan="2"></td><td>b</td></tr></table>'),
    ("<lcel><fcel>b<nl>\n", "<table><tr><td></td><td>b</td></tr></table>"),  # no owner
    ("<fcel>a<nl>\n<fcel>b", "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>"),  # the last end is missing
    ("no tags", ""), ("", ""), ("<nl>", ""),
    ("<fcel>a<fcel>b<nl><fcel>c<nl>", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td></td></tr></table>"),  # a short row
    ("<fcel>a<lcel><nl>\n<ucel><xcel><nl>\n", '<table><tr><td rowspan="2" colspan="2">a</td></tr><tr></tr></table>'),
    ("<fcel>x & <b>y</b><nl>\n", "<table><tr><td>x & <b>y</b></td></tr></table>"),
]


@pytest.mark.parametrize("value,want", GOLDEN)
def test_golden(value, want):
    assert to_html(value) == want


def grid(rng, h, w):
    """A well-formed grid of random blocks."""
    slots = [[None] * w for _ in range(h)]
    out = []
    for r in range(h):
        for c in range(w):
            if slots[r][c]:
                continue
            hh, ww = rng.randint(1, min(3, h - r)), rng.randint(1, min(3, w - c))
            while any(slots[r + i][c + j] for i in range(hh) for j in range(ww)):
                ww -= 1
            for i in range(hh):
                for j in range(ww):
                    slots[r + i][c + j] = "fcel" if i == j == 0 else "lcel" if i == 0 else "ucel" if j == 0 else "xcel"
            out.append((r, c, hh, ww))
    # Neighbouring blocks must not join: only keep grids that read back alike.
    text = "".join("".join(f"<{t}>" + ("t" if t == "fcel" else "") for t in row) + "<nl>\n" for row in slots)
    return text, out


def test_plan_equals_the_value_parser(spark):
    rng = random.Random(8)
    docs = [(k, grid(rng, rng.randint(1, 6), rng.randint(1, 6))[0]) for k in range(80)] + [(900, ""), (901, "x"), (902, "<fcel>a<nl><fcel>b<fcel>c<nl>")]
    df = spark.createDataFrame(docs, "id int, otsl string").withColumn("r", F.lit("clash"))
    plan = {}
    for r in tables.relational_cells(df, "id", "otsl").collect():
        plan.setdefault(r["id"], []).append((r["r"], r["c"], r["row_span"], r["col_span"]))
    for k, v in docs:
        assert sorted(plan.get(k, [])) == [x[:4] for x in Grid(v).cells()]
    slots = tables.grid_slots(tables.relational_cells(df, "id", "otsl"), "id").groupBy("id").count().collect()
    sizes = {k: len(Grid(v).rows) * Grid(v).width for k, v in docs}
    assert all(r["count"] <= sizes[r["id"]] for r in slots)


def test_struct_and_nulls(spark):
    df = spark.createDataFrame([(1, "<fcel>a<lcel><nl>\n"), (2, None), (3, "")], "id int, otsl string")
    got = {r["id"]: (r["t"], r["h"]) for r in df.select("id", tables.read_table("otsl").alias("t"), tables.otsl_to_html("otsl").alias("h")).collect()}
    assert got[1][0]["cells"][0]["col_span"] == 2 and got[2][0]["num_rows"] == 0 and got[2][1] is None and got[3][1] == ""
    t = df.select("id", tables.tokens(F.col("otsl")).alias("t"), tables.parts(F.col("otsl")).alias("p")).collect()
    assert t[0]["t"] == ["fcel", "lcel", "nl"] and t[0]["p"] == ["<fcel>", "a", "<lcel>", "<nl>"] and t[1]["t"] is None


def test_normal_html():
    got = normalize_html('<table class="x"><thead><tr><th style="a">A&amp;B</th></tr></thead><tbody><tr><td><span>c</span> <math alttext="x^2"><mi>x</mi></math></td></tr></tbody></table>')
    assert got == '<html><body><table border="1" ><tr><td>A&B</td></tr><tr><td>c $x^2$</td></tr></table></body></html>'
    assert normalize_html("no table") == "" and normal_table("<fcel>a<nl>\n") == "<table><tr><td>a</td></tr></table>"


TABLE = "<table><tr><td>ab</td><td>c</td></tr><tr><td colspan=\"2\">d</td></tr></table>"


def test_similarity():
    assert teds(TABLE, TABLE) == 1.0 and teds("", TABLE) == 0.0 and teds(None, TABLE) == 0.0 and teds("x", TABLE) == 0.0
    other = TABLE.replace(">ab<", ">ax<")
    assert teds(TABLE, other) == pytest.approx(1 - 0.5 / 5) and teds(TABLE, other, True) == 1.0
    assert teds(TABLE, TABLE.replace(' colspan="2"', "")) == pytest.approx(1 - 1 / 5)
    assert teds(TABLE, "<table><tr><td>ab</td><td>c</td></tr></table>") == pytest.approx(1 - 2 / 5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("xy", max_size=3), max_size=3), max_size=4), st.lists(st.lists(st.text("xy", max_size=3), max_size=3), max_size=4))
def test_distance_is_a_metric_on_tables(a, b):
    html = lambda t: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in t) + "</table>"
    x, y = table_tree(html(a))[0], table_tree(html(b))[0]
    d = tree_distance(x, y)
    assert d == pytest.approx(tree_distance(y, x)) and tree_distance(x, x) == 0 and (d > 0) == (a != b)
    assert 0 <= teds(html(a), html(b)) <= 1


def test_levenshtein():
    assert levenshtein(list("kitten"), list("sitting")) == 3 and levenshtein([], list("ab")) == 2 and levenshtein(list("ab"), list("ab")) == 0


def test_gate_keeps_whole_values(spark, tmp_path):
    from quillgrid.plans import catalog

    values = ["<fcel>a<nl>\n" * 100, "<fcel>" + "b" * 30_000 + "<nl>", "<fcel>a", None]
    spark.createDataFrame([(k, v, 0) for k, v in enumerate(values)], "record_id bigint, otsl string, ingested_at int").write.parquet(f"{tmp_path}/examples_output.parquet")
    got = {r["record_id"]: r["gated"] for r in catalog.queries()["t14_completion_gate_whole"](spark, str(tmp_path)).collect()}
    assert got == {0: values[0], 1: values[1][:30_000], 2: "ERROR", 3: None}
