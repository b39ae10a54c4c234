import random

from pyspark.sql import functions as F

from quillgrid.llm import truncation
from quillgrid.llm.truncation import canonical, prefix_runs, read_html, read_otsl, truncated, truncation_rates

FULL_O = "<fcel>a<fcel>b<nl>\n<fcel>c1<ecel><nl>\n<fcel>d<fcel>end<nl>\n"
FULL_H = "<table><tr><td>a</td><td>b</td></tr><tr><td>c1</td><td></td></tr><tr><td>d</td><td>end</td></tr></table>"


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, otsl string, html string, source string")


def cut(spark, rows):
    return {(r["id"], r["field"]) for r in truncated(frame(spark, rows)).where("cut").collect()}


def test_reading():
    assert read_otsl(FULL_O).cells == read_html(FULL_H).cells == ["a", "b", "c1", "", "d", "end"]
    assert read_html("<TABLE >\n<TR><TD ROWSPAN='2'>x &amp; y</TD ></TR>\n</TABLE></body><!-- p 3 -->").cells == ["x & y"]
    assert canonical(["a", "b", "c1"]).startswith(canonical(["a", "b", "c"])) and not canonical(["a", "b"]).startswith(canonical(["b"]))


def test_cases(spark):
    rows = [
        (1, FULL_O, FULL_H, "s"),
        (2, FULL_O[:-5], FULL_H, "s"),  # only the last <nl> is missing
        (3, FULL_O[:20], FULL_H, "s"),
        (4, FULL_O, FULL_H[:60], "s"),
        (5, "<fcel>a<fcel>b<nl>\n", FULL_H, None),  # ends with a row, but the other shows more
        (6, FULL_O, "<table><tr><td>a</td><td>b</td></tr></table>", None),
        (7, None, None, "s"), (8, "", " ", "s"), (9, None, FULL_H, "s"), (10, FULL_O, None, "s"),
        (11, FULL_O[:-14] + " [truncated]", None, "s"), (12, FULL_O[:40] + "<fc", None, "t"),
        (13, "<fcel>p<fcel>q<nl>\n<fcel>r", None, "t"),
        (3, FULL_O[:20], FULL_H, "s"),  # delivered again
    ]
    assert cut(spark, rows) == {(3, "otsl"), (4, "html"), (5, "otsl"), (6, "html"), (11, "otsl"), (12, "otsl"), (13, "otsl")}
    found = truncated(frame(spark, rows).withColumn("cut", F.lit(1)).withColumn("canonical", F.lit("x")))
    rates = {(r["source"], r["field"]): (r["n_values"], r["n_cut"]) for r in truncation_rates(found).collect()}
    assert rates[None, "otsl"] == (2, 1) and rates["s", "html"] == (5, 1)


def test_runs_over_partition_bounds(spark):
    """Runs of longer copies within a partition, over many and to the last, against all pairs."""
    rng = random.Random(4)
    forms = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(400)} | {"c" * k for k in range(1, 60)})
    df = spark.createDataFrame(list(enumerate(forms)), "fp bigint, form string")
    for parts in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["fp"]: (r["pos"], r["end"]) for r in prefix_runs(df.repartition(3)).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert len(got) == len(forms)
        for i, a in enumerate(forms):
            assert {j for j in range(len(forms)) if got[i][0] < got[j][0] <= got[i][1]} == {j for j, b in enumerate(forms) if b != a and b.startswith(a)}


def test_the_join_decides(spark, monkeypatch):
    """Without the search for longer copies, a value that ends with a row is whole."""
    rows = [(1, "<fcel>a<fcel>b<nl>\n", FULL_H, "s"), (2, "<ecel><nl>\n", FULL_H, "s"), (3, FULL_O, FULL_H, "s"), (4, "<fcel>a<fcel>b<nl>\n", None, "s")]
    assert cut(spark, rows) == {(1, "otsl"), (2, "otsl")}
    seen = {(r["id"], r["field"]): r["prefix_of_longer"] for r in truncated(frame(spark, rows)).collect()}
    assert seen[4, "otsl"] and seen[2, "otsl"] and not seen[3, "html"]
    monkeypatch.setattr(truncation, "prefix_runs", lambda forms: spark.createDataFrame([], "fp bigint, pos bigint, end bigint"))
    assert cut(spark, rows) == set()


def test_empty(spark):
    assert truncated(frame(spark, [])).count() == 0
