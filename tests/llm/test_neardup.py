import random
import re
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillgrid.llm import neardup
from quillgrid.llm.components import components
from quillgrid.llm.neardup import near_duplicates, version_groups, version_pairs


def corpus():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(900)] + ["the", "of", "table", "row"] * 40
    rows = []
    for k in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            half = len(w) // 2
            rows.append(" ".join(w if rng.random() < 0.8 else w[half:] + w[:half]))
    return [(k, "ask", t) for k, t in enumerate(rows)] + [(1000, None, rows[0]), (1001, None, rows[0]), (1002, "", None), (1003, "x", ""), (1004, None, None)]


def brute(rows, least, t=Fraction(3, 4)):
    sets = {k: set(f"{a or ''} {b or ''}".split()) for k, a, b in rows if len((b or "").split()) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) * t.denominator >= len(sets[a] | sets[b]) * t.numerator}


def test_pairs_and_groups_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + rows[:5], "row_id bigint, instruction string, output string").withColumn("fp", F.lit("clash")).withColumn("seq", F.lit(1))
    members, pairs = near_duplicates(df, "row_id", ["instruction", "output"], "output", 15)
    got = {(r["id_a"], r["id_b"]) for r in version_pairs(members, pairs).collect()}
    want = brute(rows, 15)
    assert got == want
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {r["id"]: r for r in version_groups(members, pairs).collect()}
    assert {k: r["group_id"] for k, r in groups.items()} == {k: find(k) for k in {x for p in want for x in p}}
    assert all(r["n_links"] == sum(k in p for p in want) for k, r in groups.items())


def test_a_third_of_the_rows_alike(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(k, same) for k in range(40)] + [(100 + k, " ".join(f"q{k}x{j}" for j in range(10))) for k in range(80)]
    members, pairs = near_duplicates(spark.createDataFrame(rows, "id bigint, t string"), "id", ["t"])
    assert pairs.count() == 0
    groups = version_groups(members, pairs).collect()
    assert len(groups) == 40 and all(r["group_size"] == 40 and r["n_links"] == 39 for r in groups)


@pytest.mark.parametrize("hot, block, t", [(64, 1024, Fraction(3, 4)), (1, 1024, Fraction(3, 4)), (1, 3, Fraction(1, 2)), (64, 2, Fraction(3, 4)), (1, 2, Fraction(4, 5))])
def test_any_order_and_scattered_words(spark, monkeypatch, hot, block, t):
    """Shuffled words, moved items of two words, swapped neighbours, a frequent word replaced throughout and
    words inserted evenly leave few n-grams, but much the same sets; so do columns cut into small blocks."""
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(5)
    texts = ["solo", "solo duo", "duo trio", "solo duo trio"]
    for k in range(25):
        base = [f"t{k}w{i}" if i % 2 else f"c{rng.randrange(40)}" for i in range(rng.randint(8, 60))]
        items = [base[i : i + 2] for i in range(0, len(base), 2)]
        rng.shuffle(items)
        spread = [w for i, b in enumerate(base) for w in ([b, f"n{k}x{i}"] if i % 4 == 1 else [b])]
        swapped = [w for i in range(0, len(base), 2) for w in reversed(base[i : i + 2])]
        common = max(set(base), key=base.count)
        replaced = ["instead" if w == common else w for w in base]
        texts += [" ".join(base), " ".join(rng.sample(base, len(base))), " ".join(w for x in items for w in x), " ".join(spread), " ".join(swapped), " ".join(replaced)]
    rows = [(k, "", x) for k, x in enumerate(texts)]
    members, pairs = near_duplicates(spark.createDataFrame(rows, "id bigint, i string, t string"), "id", ["t"], threshold=t)
    got = {(r["id_a"], r["id_b"]) for r in version_pairs(members, pairs).collect()}
    want = brute(rows, 1, t)
    assert got == want and len(want) > 75


def test_words():
    texts = ["", "Ab_c 1,2 D", "naïve Ünter_2 漢字x", "a\u00a0b\x1fc", "ﬁ İ ² ½", "ends in é"]
    for some in (texts, texts[:2]):
        for text, words in zip(some, neardup.words_in(some)):
            assert [w.decode() if isinstance(w, bytes) else w for w in words] == re.findall(r"[^\W_]+", text.lower())
    assert neardup.code_of(b"table") == neardup.code_of("table")


def test_empty(spark):
    members, pairs = near_duplicates(spark.createDataFrame([], "id bigint, t string"), "id", ["t"])
    assert members.count() == pairs.count() == version_pairs(members, pairs).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0
