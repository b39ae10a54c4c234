"""The p-queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scan, stored, table
from .encode import encode_corpus, with_token_counts
from .language import fit_languages
from .mixing import mixture
from .neardup import near_duplicates, version_groups, version_pairs, wordless_rows
from .packing import pack, packing_report
from .pairs import defective_pairs
from .repetition import repeated_shares, repetition
from .splitting import split_oversized
from .truncation import truncated, truncation_rates


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(scan(spark, d, "examples_output", ["record_id", "otsl", "html", "source"])).where("cut").select(F.col("id").alias("record_id"), "field")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(truncated(scan(spark, d, "examples_output", ["record_id", "otsl", "html", "source"])))


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Messages of chatml and outputs of alpaca: (row_id, part, n_tokens), each key once."""
    messages = scan(spark, d, "chatml", ["row_id", "messages"]).select("row_id", F.posexplode("messages").alias("part", "m")).select("row_id", "part", F.col("m.content").alias("text"))
    outputs = scan(spark, d, "alpaca", ["row_id", "output"]).select("row_id", F.lit(0).alias("part"), F.col("output").alias("text"))
    return tuple(stored(with_token_counts(t.where("text <> ''"), "text", ["row_id", "part"]).dropDuplicates(["row_id", "part"])) for t in (messages, outputs))


def _packings(spark: SparkSession, d: str, **how):
    """(limit_name, table_name, capacity, assigned, certificates) of each packing limit."""
    limits = {r["limit_name"]: r["max_tokens"] for r in table(spark, d, "size_limits").where("limit_name like 'pack%'").collect()}  # a fixed list
    chatml, alpaca = _items(spark, d)
    for name in sorted(limits):
        items, source = (chatml, "chatml") if "chatml" in name else (alpaca, "alpaca")
        yield name, source, limits[name], *pack(items, limits[name], ["row_id", "part"], **how)


def p2_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every item with its container, for each packing limit."""
    return _union(a.select(F.lit(n).alias("limit_name"), F.lit(s).alias("table_name"), *a.columns) for n, s, _, a, _ in _packings(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, certified lower bound and fill of each packing."""
    return _union(packing_report(a, c).select(F.lit(n).alias("limit_name"), "*") for n, _, c, a, _ in _packings(spark, d))


def p2_certificates(spark: SparkSession, d: str) -> DataFrame:
    """The certificate of every partition of every round, in partitions of 400 items, so that many exchange theirs."""
    return _union(c.select(F.lit(n).alias("limit_name"), "*") for n, _, _, _, c in _packings(spark, d, partition_items=400))


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    versions = near_duplicates(scan(spark, d, "alpaca", ["row_id", "instruction", "output"]), "row_id", ["instruction", "output"], counted="output", min_words=60)
    return version_pairs(*versions).select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every row that has a text, however short; a row without a version is its own group."""
    rows, texts = scan(spark, d, "alpaca", ["row_id", "instruction", "output"]), ["instruction", "output"]
    groups = version_groups(*near_duplicates(rows, "row_id", texts), singles=True)
    return groups.unionByName(wordless_rows(rows, "row_id", texts)).withColumnRenamed("id", "row_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition(scan(spark, d, "examples_output", ["record_id", "otsl"]), only_found=True).select(F.col("id").alias("record_id"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every value's exact share of repeated words."""
    r = repeated_shares(scan(spark, d, "examples_output", ["record_id", "otsl"]))
    return r.select(F.col("id").alias("record_id"), "n_words", F.round("share", 9).alias("share"), "broken")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every value's probability, and the exact share where that lets it through."""
    r = repetition(scan(spark, d, "examples_output", ["record_id", "otsl"]))
    return r.select(F.col("id").alias("record_id"), F.round("share", 9).alias("share"), F.round("probability", 6).alias("probability"), "likely", "broken")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    profile = fit_languages(table(spark, d, "documents"), "doc_id", "text", "lang")
    alpaca = defective_pairs(scan(spark, d, "alpaca", ["row_id", "instruction", "output"]), "row_id", "instruction", "output", profile)
    multi = defective_pairs(scan(spark, d, "multi_modal_2", ["row_id", "query", "response"]), "row_id", "query", "response", profile)
    named = lambda t, n: t.select(F.lit(n).alias("table_name"), F.col("id").alias("row_id"), "defect")
    return named(alpaca, "alpaca").unionByName(named(multi, "multi_modal_2"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(scan(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text")


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return with_token_counts(scan(spark, d, "documents", ["doc_id", "source", "text"]), "text", ["doc_id", "source"])


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture of exactly the target shares."""
    return mixture(_counted(spark, d), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(_counted(spark, d), table(spark, d, "mix_targets"))[1]


def p7_enlarged(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture of half as many tokens again as there are, more than exactly the target shares allow: the exponent lies below 1."""
    docs = stored(_counted(spark, d))
    size = docs.agg(F.sum("n_tokens")).first()[0]
    return mixture(docs, table(spark, d, "mix_targets"), size=1.5 * (size or 0))[1]


def p7_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture whose weights are the sources' token shares to the power that gives nearly even weights their entropy."""
    targets = table(spark, d, "mix_targets")
    return mixture(_counted(spark, d), targets, entropy=0.9 * math.log(max(targets.count(), 1)))[1]


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = [(r["limit_name"], r["max_tokens"], r["overlap_tokens"] or 0) for r in table(spark, d, "size_limits").where("limit_name like 'split%'").orderBy("limit_name").collect()]  # a fixed list
    return split_oversized(scan(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text", limits)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_rates, p2_packing, p2_report, p2_certificates, p3_found, p3_groups, p4_found, p4_shares, p4_scores, p5_found, p6_ids, p7_mixture, p7_shares, p7_enlarged, p7_tempered, p8_pieces)
}

#: The same results by brute force in SQL, where whole tables allow it.
ORACLE: dict[str, str] = {
    "p4_found": r"""
WITH v AS (SELECT DISTINCT record_id, regexp_extract_all(lower(regexp_replace(otsl, '<(nl|fcel|ecel|lcel|ucel|xcel)>', ' ', 'g')), '[\p{L}\p{N}]+') AS w
           FROM examples_output WHERE otsl IS NOT NULL),
g AS (SELECT record_id, i, list_slice(w, i, i + 5) AS gram FROM (SELECT record_id, w, unnest(range(1, len(w) - 4)) AS i FROM v WHERE len(w) >= 6)),
r AS (SELECT record_id, i FROM (SELECT record_id, i, row_number() OVER (PARTITION BY record_id, gram ORDER BY i) AS k FROM g) WHERE k > 1),
m AS (SELECT record_id, count(DISTINCT i + o) AS n FROM r, range(0, 6) t(o) GROUP BY record_id)
SELECT m.record_id FROM m JOIN v USING (record_id) WHERE m.n >= 0.4 * len(v.w)""",
    "p4_shares": r"""
WITH v AS (SELECT DISTINCT record_id, regexp_extract_all(lower(regexp_replace(coalesce(otsl, ''), '<(nl|fcel|ecel|lcel|ucel|xcel)>', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM examples_output),
g AS (SELECT record_id, i, list_slice(w, i, i + 5) AS gram FROM (SELECT record_id, w, unnest(range(1, len(w) - 4)) AS i FROM v WHERE len(w) >= 6)),
r AS (SELECT record_id, i FROM (SELECT record_id, i, row_number() OVER (PARTITION BY record_id, gram ORDER BY i) AS k FROM g) WHERE k > 1),
m AS (SELECT record_id, count(DISTINCT i + o) AS n FROM r, range(0, 6) t(o) GROUP BY record_id)
SELECT v.record_id, len(v.w)::BIGINT AS n_words, round(coalesce(m.n, 0) / greatest(len(v.w), 1), 9) AS share, coalesce(m.n, 0) >= 0.4 * greatest(len(v.w), 1) AS broken
FROM v LEFT JOIN m USING (record_id)""",
    "p3_found": r"""
WITH t AS (SELECT DISTINCT row_id, regexp_extract_all(lower(coalesce(output, '')), '[\p{L}\p{N}]+') AS o,
                  list_distinct(regexp_extract_all(lower(coalesce(instruction, '') || ' ' || coalesce(output, '')), '[\p{L}\p{N}]+')) AS w FROM alpaca),
s AS (SELECT row_id, len(w) AS n, unnest(w) AS word FROM t WHERE len(o) >= 60),
c AS (SELECT x.row_id AS a, y.row_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM s x JOIN s y ON x.word = y.word AND x.row_id < y.row_id AND 4 * x.n >= 3 * y.n AND 4 * y.n >= 3 * x.n GROUP BY ALL)
SELECT a AS row_id_a, b AS row_id_b FROM c WHERE 4 * k >= 3 * (na + nb - k)""",
}
