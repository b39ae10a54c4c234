import random

from pyspark.sql import functions as F

from quillgrid.llm import repetition as module
from quillgrid.llm.repetition import TAGS, WORDS, Batch, repeated_shares, repetition


def share(value):
    w = WORDS.findall(TAGS.sub(" ", value).lower()) if value else []
    seen, mark = set(), [False] * len(w)
    for i in range(len(w) - 5):
        g = tuple(w[i : i + 6])
        if g in seen:
            mark[i : i + 6] = [True] * 6
        seen.add(g)
    return sum(mark) / max(1, len(w))


def values(n=400):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    out = [None, "", "<nl>", "a b c", "x " * 3000]
    for k in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if k % 6 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = body[:20] * rng.randint(1, 9)
        out.append("<fcel>" + "<fcel>".join(body))
    return out


def test_shares_against_brute_force():
    vs = values()
    assert [round(x, 9) for x in Batch(vs).shares()] == [round(share(v), 9) for v in vs]


def test_broken_equals_the_exact_rule(spark):
    vs = values()
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vs)] + [(5, vs[5])], "record_id bigint, otsl string").withColumn("share", F.lit("clash"))
    got = {r["id"]: r for r in repetition(df).collect()}
    assert len(got) == len(vs)
    assert all(r["share"] is None or abs(r["share"] - share(vs[k])) < 1e-9 for k, r in got.items())
    assert {k for k, r in got.items() if r["broken"]} == {k for k, v in enumerate(vs) if share(v) >= 0.4}
    likely = sum(r["likely"] == (share(vs[k]) >= 0.4) for k, r in got.items()) / len(vs)
    assert likely > 0.95
    assert {r["id"] for r in repetition(df, only_found=True).collect()} == {k for k, r in got.items() if r["broken"]}


def test_held_out_values(spark):
    """Fitted on a part of the values, the probability alone tells the others apart."""
    vs = [f"<fcel>{k} " + (v or "") for k, v in enumerate(values(1500))]
    df = spark.createDataFrame(list(enumerate(vs)), "record_id bigint, otsl string")
    fitted = {r["record_id"] for r in df.orderBy(F.xxhash64("record_id")).limit(600).collect()}
    got = [(r["likely"], r["probability"], share(vs[r["id"]]) >= 0.4) for r in repetition(df, sample_rows=600).collect() if r["id"] not in fitted]
    found, true = sum(a for a, _, _ in got), sum(b for _, _, b in got)
    both = sum(a and b for a, _, b in got)
    assert true > 60 and both / true >= 0.9 and both / found >= 0.9
    assert all(p >= module.LET_THROUGH for _, p, b in got if b)


def test_the_probability_gates(spark, monkeypatch):
    """A value that the regression doesn't let through isn't broken, and has no exact share."""
    monkeypatch.setattr(module, "LET_THROUGH", 2.0)
    df = spark.createDataFrame(list(enumerate(values())), "record_id bigint, otsl string")
    rows = [r for b in module._score({"weights": [0.0] * (module.CELLS + 1), "scale": 1.0, "shift": 0.0}, df.select(F.col("record_id").alias("id"), F.col("otsl").alias("value")).toArrow().to_batches(), False) for r in b.to_pylist()]
    assert len(rows) == df.count() and not any(r["broken"] for r in rows) and all(r["share"] is None for r in rows)


def test_every_share(spark):
    vs = values()
    df = spark.createDataFrame(list(enumerate(vs)) + [(5, vs[5])], "record_id bigint, otsl string").withColumn("n_words", F.lit("clash"))
    got = {r["id"]: r for r in repeated_shares(df).collect()}
    assert len(got) == len(vs) and all(abs(r["share"] - share(vs[k])) < 1e-9 and r["broken"] == (share(vs[k]) >= 0.4) for k, r in got.items())
    assert repeated_shares(df.limit(0)).count() == 0


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "record_id bigint, otsl string")
    assert [r["broken"] for r in repetition(df).collect()] == [False, False]
    assert repetition(df.limit(0)).count() == 0
