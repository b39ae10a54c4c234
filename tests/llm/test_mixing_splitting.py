import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm.bpe import counter
from quillgrid.llm.mixing import exponent_for_entropy, exponent_within_repeats, mixture, weights_at
from quillgrid.llm import splitting
from quillgrid.llm.splitting import Task, before_of, best_cuts, split_oversized, split_texts, steps_of


def test_exponents():
    shares = [0.7, 0.2, 0.1]
    a = exponent_for_entropy(shares, 1.0)
    w = [s**a for s in shares]
    assert abs(-sum(x / sum(w) * math.log(x / sum(w)) for x in w) - 1.0) < 1e-6
    assert weights_at([0.5, 0.5, 0.0], [0.2, 0.3, 0.5], 1.0) == pytest.approx([0.4, 0.6, 0.0])
    assert exponent_within_repeats([0.9, 0.1], [0.5, 0.5], [1, 2], 100, 1000) == 1.0
    x = exponent_within_repeats([0.9, 0.1], [0.5, 0.5], [1, 2], 1000, 1000)
    assert 0 < x < 1 and 1000 * weights_at([0.9, 0.1], [0.5, 0.5], x)[1] == pytest.approx(200, rel=1e-6)


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None]), rng.choice([0, 1, 20, 30, 400])) for k in range(4000)]
    docs = spark.createDataFrame(rows + rows[:7], "doc_id bigint, source string, n_tokens bigint").withColumn("h", F.lit("clash")).withColumn("block", F.lit(1))
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 3), ("c", 0.15, 2), ("d", 0.05, 2)], "source string, target_share double, max_repeats int")
    uses, shares = mixture(docs, targets)
    got = uses.collect()
    most = {"a": 1, "b": 3, "c": 2}
    assert len({r["doc_id"] for r in got}) == len(got) and all(1 <= r["n_uses"] <= most[r["source"]] for r in got)
    s = {r["source"]: r["actual_share"] for r in shares.collect()}
    assert s["d"] == 0 and all(abs(s[k] - t / 0.95) < 0.01 for k, t in (("a", 0.3), ("b", 0.5), ("c", 0.15)))
    u, s = mixture(docs.limit(0), targets)
    assert u.count() == 0 and {r["actual_share"] for r in s.collect()} == {0.0}
    u, s = mixture(docs, targets.limit(0))
    assert u.count() == 0 and s.count() == 0


def test_mixture_above_the_targets_and_to_an_entropy(spark):
    rows = [(k, "abc"[(k > 700) + (k > 950)], 10 + k % 7) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 2), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    total = sum(r[2] for r in rows)
    uses, shares = mixture(docs, targets, size=float(total))
    s = {r["source"]: r for r in shares.collect()}
    assert 0 < s["a"]["exponent"] < 1
    assert all(r["n_uses"] <= {"a": 1, "b": 2, "c": 3}[r["source"]] for r in uses.collect())
    assert s["c"]["mixed_tokens"] == pytest.approx(3 * s["c"]["n_tokens"], rel=0.02)  # the source that binds
    assert sum(r["mixed_tokens"] for r in s.values()) == pytest.approx(total, rel=0.02)
    _, shares = mixture(docs, targets, size=total / 10, entropy=1.0)
    s = {r["source"]: r for r in shares.collect()}
    w = [r["actual_share"] for r in s.values()]
    assert 0 < s["a"]["exponent"] < 1 and -sum(x * math.log(x) for x in w) == pytest.approx(1.0, abs=0.03)
    _, shares = mixture(docs, targets, entropy=math.log(3))
    s = {r["source"]: r for r in shares.collect()}
    assert 0 < s["a"]["exponent"] < 1 and s["c"]["mixed_tokens"] == pytest.approx(3 * s["c"]["n_tokens"], rel=0.02)


LIMITS = [("big", 120, 16), ("small", 40, 0)]


def texts():
    rng = random.Random(7)
    words = ["table", "row", "Velgreven", "naïve", "漢字", "👍🏽", "12,345", "it's"]
    out = [None, "", "short", "漢" * 900, "a" * 3000, "\n" * 500, " " * 700, "é👍🏽" * 300, "x\r\n\r\ny. " * 200]
    for _ in range(60):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", ". ", "\n", "\n\n", ", ", ""]) for _ in range(rng.randint(1, 400))))
    return out


def check(text, pieces, limit, overlap):
    assert [p[1] for p in pieces] == list(range(len(pieces))) and all(p[2] == len(pieces) for p in pieces)
    assert "".join(p[7][p[5] :] for p in pieces) == text
    count = counter()
    assert all(c <= limit for c in count([p[7] for p in pieces])) and [p[6] for p in pieces] == count([p[7] for p in pieces])
    assert all(text[p[3] : p[4]] == p[7] for p in pieces)
    assert all((p[5] > 0) == (overlap > 0) for p in pieces[1:])


def test_split_round_trip():
    count = counter()
    for t in texts():
        got = [r[1:] for r in split_texts([t or ""], LIMITS, "byte_bpe_50k", "/opt/tokenizers")]
        for name, limit, overlap in LIMITS:
            mine = [p for p in got if p[0] == name]
            if count([t or ""])[0] <= limit:
                assert not mine
            else:
                check(t, mine, limit, overlap)


def test_texts_are_graded_together_as_alone(monkeypatch):
    monkeypatch.setattr(splitting, "TOGETHER", 1000)
    alone = [(i, *r[1:]) for i, t in enumerate(texts()) for r in split_texts([t], LIMITS, "byte_bpe_50k", "/opt/tokenizers")]
    assert sorted(split_texts(texts(), LIMITS, "byte_bpe_50k", "/opt/tokenizers")) == sorted(alone)


def test_cuts_where_the_text_pauses():
    text = "\n\n".join("One sentence of a paragraph that goes on for a while. And a second one." for _ in range(30))
    got = [r[1:] for r in split_texts([text], [("n", 60, 0)], "byte_bpe_50k", "/opt/tokenizers")]
    assert all(p[7].endswith("\n\n") for p in got[:-1])


def test_split_frame(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("piece", F.lit("clash"))
    got = split_oversized(df, "doc_id", "text", LIMITS).collect()
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["limit_name"]), []).append(tuple(r)[1:])
    for (k, name), pieces in by.items():
        limit, overlap = {n: (m, o) for n, m, o in LIMITS}[name]
        check(dict(rows)[k], sorted(pieces, key=lambda p: p[1]), limit, overlap)
    assert split_oversized(df.limit(0), "doc_id", "text", LIMITS).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "doc_id", "text", [("bad", 10, 10)])


def test_no_cheaper_cuts(monkeypatch):
    """Pieces cost what a plain program over all places finds, whatever the number of texts, lanes and blocks."""
    rng = np.random.default_rng(11)
    tasks = []
    for _ in range(60):
        n = int(rng.integers(20, 300))
        grade = rng.choice([0, 0.15, 0.4, 1, 2, 3, 12, np.inf], n + 1, p=[0.01, 0.02, 0.05, 0.1, 0.3, 0.02, 0.4, 0.1])
        grade[0] = grade[n] = 2.0
        room = int(rng.integers(8, 60))
        tasks.append(Task(grade, before_of(grade), room, int(rng.integers(0, room // 3))))
    solid = np.array([2.0] + [np.inf] * 30 + [2.0])
    tasks.append(Task(solid, before_of(solid), 10, 2))
    costs = []
    for lanes in (64, 3):
        monkeypatch.setattr(splitting, "LANES", lanes)
        for task, pieces in zip(tasks, best_cuts(tasks)):
            x = steps_of(task, np.isfinite(task.grade))
            least = [0.0]
            for k in range(1, len(x.end)):
                least.append(x.fee[k] + min((least[j] + x.scale * (x.end[k] - x.begin[j] - x.ideal) ** 2 for j in range(k) if x.end[k] - x.begin[j] <= task.room), default=math.inf))
            if pieces is None:
                assert least[-1] == math.inf
                continue
            fee = dict(zip(x.end.tolist(), x.fee.tolist()))
            assert all(e - b <= task.room for b, e in pieces)
            costs.append(sum(fee[e] + x.scale * (e - b - x.ideal) ** 2 for b, e in pieces))
            assert costs[-1] == pytest.approx(least[-1])
    assert len(costs) > 100


def plain(task):
    """The least cost of a cutting over all places."""
    x = steps_of(task, np.isfinite(task.grade))
    least = [0.0]
    for k in range(1, len(x.end)):
        least.append(x.fee[k] + min((least[j] + x.scale * (x.end[k] - x.begin[j] - x.ideal) ** 2 for j in range(k) if x.end[k] - x.begin[j] <= task.room), default=math.inf))
    return least[-1]


def random_task(rng, n, room, overlap, weights):
    grade = rng.choice([0, 0.15, 0.4, 1, 2, 3, 12, np.inf], n + 1, p=weights)
    grade[0] = grade[n] = 2.0
    return Task(grade, before_of(grade), room, overlap)


def test_texts_that_end_within_a_stride_of_longer_ones():
    """A text with few places in a piece keeps the room where the program goes on with longer texts."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        tasks = [random_task(rng, 206, 60, 7, [0, 0, 0, 0, 0.5, 0, 0.5, 0])]
        tasks += [random_task(rng, n, 60, 7, [0, 0, 0, 0, 0.3, 0, 0.2, 0.5]) for n in (380, 370, 360)]
        steps = sorted((steps_of(t, np.isfinite(t.grade)) for t in tasks), key=lambda x: -len(x.end))
        got = splitting.cheapest(steps, pieces=False)
        assert sorted(c for c, _ in got) == pytest.approx(sorted(plain(t) for t in tasks))


def test_outdone_places_are_left_out_and_cost_nothing(monkeypatch):
    """A text of many pieces is cut as cheaply over a part of its places as over all."""
    rng = np.random.default_rng(3)
    tasks = [random_task(rng, int(rng.integers(500, 1500)), room, overlap, [0.01, 0.03, 0.03, 0.05, 0.28, 0.05, 0.5, 0.05]) for room, overlap in ((40, 5), (25, 0), (64, 20), (12, 3)) for _ in range(4)]
    assert all(splitting.least_pieces(t) > splitting.BOUNDED for t in tasks if t.room < 25)
    monkeypatch.setattr(splitting, "BOUNDED", 0)
    seen, program = [], splitting.cheapest
    monkeypatch.setattr(splitting, "cheapest", lambda many, **how: seen.extend(len(x.end) for x in many) or program(many, **how))
    cut = best_cuts(tasks)
    assert sum(seen) < 0.7 * sum(int(np.isfinite(t.grade).sum()) for t in tasks)
    for task, pieces in zip(tasks, cut):
        ideal, scale = splitting.size_of(task)
        assert all(e - b <= task.room for b, e in pieces)
        cost = sum(splitting.PIECE + scale * (e - b - ideal) ** 2 for b, e in pieces) + sum(task.grade[e] for _, e in pieces[:-1])
        assert cost == pytest.approx(plain(task))


def test_a_text_that_cannot_be_cut(spark):
    df = spark.createDataFrame([(1, "👍🏽" * 40), (2, "a b c d e f g")], "doc_id bigint, text string")
    got = split_oversized(df, "doc_id", "text", [("tiny", 2, 1)]).collect()
    assert {r["reason"] for r in got if r["doc_id"] == 1} == {"no cuts keep the limit"} and all(r["piece"] is None for r in got if r["doc_id"] == 1)
    assert all(r["reason"] is None and r["n_tokens"] <= 2 for r in got if r["doc_id"] == 2) and len(got) > 3
