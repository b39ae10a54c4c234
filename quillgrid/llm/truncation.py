"""Values that lost their tail.

Both fields of a record are brought to one canonical form, the list of cell texts in
reading order. All distinct canonical forms are range-partitioned and sorted: the longer
copies of a form are then the run of forms right after it. One pass gives every form its
place and the end of its run, and a join of these places with both fields of each record
tells which field holds less of the table than the other. What a value shows on its own
(an open tag, cell, row or table) is read beside it.
"""

from __future__ import annotations

import html as _html
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Begins each cell of a canonical form.
SEP = "\x1f"

_OTSL_TAG = re.compile(r"<(nl|fcel|ecel|lcel|ucel|xcel)>")
_OTSL_TAIL = re.compile(r"<(?:n?l?|[felux]?(?:c(?:e(?:l)?)?)?)$")
#: What writers leave where they stop: dots, a note, a count of what is left, a broken character.
_OMITTED = re.compile(r"\s*(?:\[?\.\.\.\]?|\[?…\]?\s*(?:\(\+\d+[^()]*\))?|[\[(<](?:truncated|more|cut|continued|snip)[\])>]|\ufffd+)\s*$", re.I)
_ROW = re.compile(r"<\s*tr\b", re.I)
_CELL = re.compile(r"<\s*t[dh]\b([^<>]*)>(.*?)(?=<\s*/?\s*(?:td|th|tr|table|thead|tbody|tfoot)\b|$)", re.I | re.S)
_HTML_WHOLE = re.compile(r"<\s*/\s*table\s*>\s*(?:<\s*/\s*[a-z]+\s*>\s*|<!--(?:(?!-->).)*-->\s*)*$", re.I | re.S)
_INLINE = re.compile(r"<[^<>]*>")
_PARTIAL = re.compile(r"<[^<>]*$")
_SPAN = re.compile(r"(row|col)span\s*=\s*[\"']?\s*(\d+)", re.I)


class Value(NamedTuple):
    """One field, read: its cells; whether it stops within a tag or at a mark of omission;
    whether its last row is narrower than the table; whether its last row isn't ended;
    whether the last cell of such a row looks cut."""

    cells: list[str]
    stops: bool
    short: bool
    open: bool
    torn: bool


def _shape(cell: str) -> str:
    """Letters as a, the digits after a comma, point or hyphen by their number, others as 9."""
    cell = re.sub(r"(?<=[.,-])[0-9]+", lambda m: "8" * len(m.group(0)), cell)
    return re.sub(r"[0-9]*9[0-9]*|(?<![8.,-])[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", cell))


def _torn(last: str, column: list[str]) -> bool:
    """Whether the last cell of a row without end looks cut, by the cells above it."""
    if not last or not column:
        return True
    if last in column:
        return False
    if any(c.isalpha() for c in last):
        return last.split()[-1] not in {c.split()[-1] for c in column if c}
    return _shape(last) not in {_shape(c) for c in column}


def read_otsl(value: str) -> Value:
    body = value.rstrip()
    stops = bool(_OMITTED.search(body))
    if stops:
        body = _OMITTED.sub("", body)
    tail = _OTSL_TAIL.search(body)
    if tail:
        stops = True
        body = body[: tail.start()]
    parts = _OTSL_TAG.split(body)
    cells, row, rows = [], [], []
    for k in range(1, len(parts), 2):
        tag = parts[k]
        if tag == "nl":
            if row:
                rows.append(row)
            row = []
            continue
        text = " ".join(parts[k + 1].split()) if tag == "fcel" else ""
        row.append(text)
        if tag in ("fcel", "ecel"):
            cells.append(text)
    widest = max(map(len, rows), default=0)
    ended = not row
    width = len(rows[-1]) if ended and rows else len(row)
    torn = not ended and parts[-2] == "fcel" and _torn(row[-1], [r[width - 1] for r in rows if len(r) >= width])
    return Value(cells, stops, width < widest, not ended, torn)


def read_html(value: str) -> Value:
    """Cells of HTML in any case, spacing and wrapping; spans count for a row's width."""
    whole = bool(_HTML_WHOLE.search(value))
    body = value if whole else _PARTIAL.sub("", _OMITTED.sub("", value.rstrip()))
    cells, hanging, widest, width = [], [], 0, 0
    for row in _ROW.split(body)[1:]:
        hanging = [(r - 1, c) for r, c in hanging if r > 1]
        width = sum(c for _, c in hanging)
        for spans, text in _CELL.findall(row):
            s = {k.lower(): int(v) for k, v in _SPAN.findall(spans)} if spans.strip() else {}
            rows, cols = max(1, s.get("row", 1)), max(1, s.get("col", 1))
            width += cols
            if rows > 1:
                hanging.append((rows, cols))
            if "<" in text:
                text = _PARTIAL.sub("", _INLINE.sub("", text))
            cells.append(" ".join(_html.unescape(text).split()))
        widest = max(widest, width)
    return Value(cells, not whole, width < widest, not whole, not whole)


def canonical(cells: list[str]) -> str:
    """Cells one after another, each begun by SEP, so that a list without its last cells or without
    the end of its last cell is a prefix."""
    return "".join(SEP + c for c in cells)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = ("stops", "short", "open", "torn")
    kind = pa.struct([("form", pa.string()), *[(f, pa.bool_()) for f in flags]])
    for batch in batches:
        columns = {"otsl": [], "html": []}
        for field, read in (("otsl", read_otsl), ("html", read_html)):
            for text in batch.column(field).to_pylist():
                v = read(text) if text and text.strip() else None
                columns[field].append(v and {"form": canonical(v.cells), **{f: getattr(v, f) for f in flags}})
        yield pa.record_batch([batch.column("id"), batch.column("source"), *[pa.array(c, kind) for c in columns.values()]], names=["id", "source", *columns])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each sorted partition: (fp, pos, end) of every form whose run ends in it, `end` being the
    place of its last longer copy; the forms still open at its end with their lengths; and one row of
    its first and last form, with the places at which forms cease to share so much of the first."""
    import pyspark

    part = pyspark.TaskContext.get().partitionId()
    at = (part << 40) - 1
    stack: list[tuple[str, int, int]] = []
    first, shared, breaks, last = None, 0, [], None
    names = ["part", "fp", "pos", "end", "length", "first", "last", "breaks"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)

    for batch in batches:
        rows = []
        for fp, form in zip(batch.column("fp").to_pylist(), batch.column("form").to_pylist()):
            if first is None:
                first, shared = form, len(form)
            elif not form.startswith(first[:shared]):
                shared = len(os.path.commonprefix((first[:shared], form)))
                breaks.append([shared, at + 1])
            while stack and not form.startswith(stack[-1][0]):
                _, fp0, pos = stack.pop()
                rows.append((part, fp0, pos, at, None, None, None, None))
            at += 1
            stack.append((form, fp, at))
            last = form
        yield out(rows)
    if first is not None:
        yield out([(part, fp, pos, at, len(form), None, None, None) for form, fp, pos in stack] + [(part, None, None, at, None, first, last, breaks)])


def prefix_runs(forms: DataFrame) -> DataFrame:
    """(fp, pos, end) of distinct `forms` (fp, form): a form is a strict prefix of exactly those with pos < their pos <= end."""
    ordered = forms.repartitionByRange("form").sortWithinPartitions("form")
    found = stored(ordered.mapInArrow(_runs, "part int, fp bigint, pos bigint, end bigint, length bigint, first string, last string, breaks array<array<bigint>>"))
    # Two forms of each partition, and the nested prefixes of its last one: they grow with the partitions.
    edges = {r["part"]: r for r in found.where("first is not null").select("part", "end", "first", "last", "breaks").collect()}
    parts, closed = sorted(edges), []
    for r in found.where("length is not null").select("part", "fp", "pos", "end", "length").collect():
        head, end = edges[r["part"]]["last"][: r["length"]], r["end"]
        for q in parts[parts.index(r["part"]) + 1 :]:
            if not edges[q]["first"].startswith(head):
                break
            stop = next((p for n, p in edges[q]["breaks"] if n < r["length"]), None)
            end = edges[q]["end"] if stop is None else stop - 1
            if stop is not None:
                break
        closed.append((r["fp"], r["pos"], end))
    return found.where("fp is not null and length is null").select("fp", "pos", "end").unionByName(forms.sparkSession.createDataFrame(closed, "fp bigint, pos bigint, end bigint"))


def truncated(df: DataFrame, key: str = "record_id", source: str = "source") -> DataFrame:
    """(id, source, field, prefix_of_longer, cut) of every non-blank `otsl` and `html` value.

    `prefix_of_longer`: the value's cells are a strict prefix of a longer copy somewhere in
    the table. `cut`: the record's other field is such a longer copy; or the value stops
    within a tag, a cell, a row or the table. A value that holds no cell is a prefix of every
    value with one. Null, empty and blank values give no row; a key that comes again counts
    once, and is cut if one of its rows is; ties (equal fields) are no cut. An empty table
    gives no rows, and other columns are ignored.
    """
    rows = df.select(F.col(key).alias("id"), "otsl", "html", F.col(source).alias("source"))
    value = "struct<form: string, stops: boolean, short: boolean, open: boolean, torn: boolean>"
    scanned = stored(rows.mapInArrow(_scan, f"id {dict(rows.dtypes)['id']}, source string, otsl {value}, html {value}"))
    print_of = lambda f: F.when(F.col(f).isNotNull(), F.xxhash64(f"{f}.form"))
    forms = scanned.select(F.explode(F.array_distinct(F.array("otsl.form", "html.form"))).alias("form")).where("form is not null")
    runs = prefix_runs(forms.select(F.xxhash64("form").alias("fp"), "form").dropDuplicates(["fp"]))
    flags = lambda f: F.when(F.col(f).isNotNull(), F.struct(*[F.col(f"{f}.{x}") for x in ("stops", "short", "open", "torn")])).alias(f)
    # A missing field has the record's own hash, so that these rows don't meet in one task.
    joined = scanned.select("id", "source", flags("otsl"), flags("html"), *[F.coalesce(print_of(f), F.xxhash64("id")).alias(f"{f}_fp") for f in ("otsl", "html")])
    for f in ("otsl", "html"):
        joined = joined.join(runs.select(F.col("fp").alias(f"{f}_fp"), F.struct("pos", "end").alias(f"{f}_run")), f"{f}_fp", "left")
    o, h = F.col("otsl"), F.col("html")
    within = lambda a, b: F.coalesce((F.col(f"{a}_run.pos") < F.col(f"{b}_run.pos")) & (F.col(f"{b}_run.pos") <= F.col(f"{a}_run.end")), F.lit(False))
    both = o.isNotNull() & h.isNotNull()
    same, less_o, less_h = both & (F.col("otsl_fp") == F.col("html_fp")), both & within("otsl", "html"), both & within("html", "otsl")
    # A last row without end is evidence unless the other field has the same cells, or fewer.
    alone = o["stops"] | o["short"] | (o["open"] & o["torn"])
    beside = o["stops"] | (o["open"] & (o["short"] | (o["torn"] & ~same & ~less_h)))
    cut_o = F.when(h.isNull(), alone).when(same & ~h["stops"], False).otherwise(beside | less_o)
    cut_h = h["stops"] | (o.isNull() & h["short"]) | less_h
    one = lambda f, cut: F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), (F.col(f"{f}_run.end") > F.col(f"{f}_run.pos")).alias("prefix_of_longer"), cut.alias("cut")))
    values = joined.select("id", "source", F.explode(F.array(one("otsl", cut_o), one("html", cut_h))).alias("v")).where("v is not null").select("id", "source", "v.*")
    return values.groupBy("id", "field").agg(F.max("source").alias("source"), F.max("prefix_of_longer").alias("prefix_of_longer"), F.max("cut").alias("cut"))


def truncation_rates(found: DataFrame) -> DataFrame:
    """(source, field, n_values, n_prefix, n_cut, share_cut) of the result of `truncated`; a null source is its own group."""
    return (
        found.groupBy("source", "field")
        .agg(F.count("*").alias("n_values"), F.count_if("prefix_of_longer").alias("n_prefix"), F.count_if("cut").alias("n_cut"))
        .withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_values"), 6))
    )
