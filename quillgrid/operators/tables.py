"""Table markup: tags, rows, cells with spans, dense grids and HTML.

Everything that stays within one value is an expression on built-in array functions or an
Arrow function over one column, so no value is shuffled to be parsed. `relational_cells`
and `grid_slots` are the same steps as relational plans over exploded cells.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six tags.
TAGS = ["nl", "fcel", "ecel", "lcel", "ucel", "xcel"]
TAG_PATTERN = "<(" + "|".join(TAGS) + ")>"
CELL = T.StructType(
    [
        T.StructField("row_span", T.IntegerType()),
        T.StructField("col_span", T.IntegerType()),
        T.StructField("start_row_offset_idx", T.IntegerType()),
        T.StructField("end_row_offset_idx", T.IntegerType()),
        T.StructField("start_col_offset_idx", T.IntegerType()),
        T.StructField("end_col_offset_idx", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("column_header", T.BooleanType()),
        T.StructField("row_header", T.BooleanType()),
        T.StructField("row_section", T.BooleanType()),
    ]
)
TABLE = T.StructType([T.StructField("num_rows", T.IntegerType()), T.StructField("num_cols", T.IntegerType()), T.StructField("cells", T.ArrayType(CELL))])


# ---- expressions --------------------------------------------------------------------------
def tokens(otsl: Column) -> Column:
    """All tags in order, without brackets; null for null."""
    return F.regexp_extract_all(otsl, F.lit(TAG_PATTERN), F.lit(1))


def parts(otsl: Column) -> Column:
    """Tags and texts in order; blank texts are left out."""
    return F.filter(F.split(otsl, f"(?={TAG_PATTERN})|(?<={TAG_PATTERN})"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")) != "")


def tag_rows(otsl: Column) -> Column:
    """Arrays of tags of each row; empty rows vanish."""
    joined = F.array_join(tokens(otsl), " ")
    return F.filter(F.transform(F.split(joined, r"(?:^|\s)nl(?=\s|$)"), lambda r: F.filter(F.split(F.trim(r), " "), lambda t: t != "")), lambda r: F.size(r) > 0)


def width(rows: Column) -> Column:
    """Cells of the widest row; 0 without rows."""
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def rectangular(rows: Column) -> Column:
    """Short rows padded with `ecel` to the widest."""
    w = width(rows)
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit("ecel"), w - F.size(r))))


def strip(text: Column) -> Column:
    """All white space off both ends, as trim() takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# ---- one value ----------------------------------------------------------------------------
_SPLIT = re.compile(TAG_PATTERN)


class Grid:
    """The tags of a table in a rectangle, with the texts their cells own."""

    def __init__(self, otsl: str):
        pieces = _SPLIT.split(otsl)
        stream: list[tuple[str, str]] = [("text", pieces[0])] if pieces[0].strip() else []
        for tag, text in zip(pieces[1::2], pieces[2::2]):
            stream.append((tag, ""))
            if text.strip():
                stream.append(("text", text))
        rows: list[list[str]] = [[]]
        for kind, _ in stream:
            if kind == "nl":
                rows.append([])
            elif kind != "text":
                rows[-1].append(kind)
        self.rows = [r for r in rows if r]
        self.width = max(map(len, self.rows), default=0)
        for r in self.rows:
            r += ["ecel"] * (self.width - len(r))
        self.texts = self._own(stream)

    def _own(self, stream: list[tuple[str, str]]) -> dict[tuple[int, int], str]:
        """Text of each slot. A text is taken only while the stream agrees with the rectangle:
        what stands before a tag that doesn't fit blocks all that follows."""
        own, at = {}, 0
        kind = lambda k: stream[k][0] if k < len(stream) else None
        for r, row in enumerate(self.rows):
            for c, tag in enumerate(row):
                if kind(at) == tag:
                    at += 1
                    if kind(at) == "text":
                        own[r, c] = stream[at][1]
                        at += 1
            at += kind(at) == "nl"
        return own

    def run(self, r: int, c: int, dr: int, dc: int, tags: tuple[str, str]) -> int:
        n = 0
        while r + dr * (n + 1) < len(self.rows) and c + dc * (n + 1) < self.width and self.rows[r + dr * (n + 1)][c + dc * (n + 1)] in tags:
            n += 1
        return n

    def cells(self) -> list[tuple]:
        """(row, column, rows, columns, text) of the owning cells in reading order."""
        out = []
        for r, row in enumerate(self.rows):
            for c, tag in enumerate(row):
                if tag not in ("fcel", "ecel"):
                    continue
                text = self.texts.get((r, c))
                # A text after an empty cell's tag is dropped and hides the columns it spans.
                right = 0 if tag == "ecel" and text is not None else self.run(r, c, 0, 1, ("lcel", "xcel"))
                out.append((r, c, 1 + self.run(r, c, 1, 0, ("ucel", "xcel")), 1 + right, (text or "").strip() if tag == "fcel" else ""))
        return out

    def html(self) -> str:
        cells = self.cells()
        if not cells:
            return ""
        at = {(r, c): (rs, cs, t) for r, c, rs, cs, t in cells}
        covered = {(r + i, c + j) for r, c, rs, cs, _ in cells for i in range(rs) for j in range(cs)}
        body = []
        for r in range(len(self.rows)):
            body.append("<tr>")
            for c in range(self.width):
                if (r, c) in at:
                    rs, cs, t = at[r, c]
                    body.append("<td" + f' rowspan="{rs}"' * (rs > 1) + f' colspan="{cs}"' * (cs > 1) + f">{t}</td>")
                elif (r, c) not in covered:
                    body.append("<td></td>")
            body.append("</tr>")
        return "<table>" + "".join(body) + "</table>"


def to_html(otsl: str) -> str:
    """HTML of a value; '' without tags or cells. Texts aren't escaped."""
    return Grid(otsl).html()


@F.pandas_udf(T.StringType())
def otsl_to_html(otsl: pd.Series) -> pd.Series:
    """HTML of every value; null for null, '' for values without cells."""
    return otsl.map(to_html, na_action="ignore")


@F.pandas_udf(TABLE)
def read_table(otsl: pd.Series) -> pd.DataFrame:
    """struct(num_rows, num_cols, cells) of every value; null and empty values have no cells."""
    out = []
    for v in otsl:
        g = Grid(v or "")
        cells = [(rs, cs, r, r + rs, c, c + cs, t, False, False, False) for r, c, rs, cs, t in g.cells()]
        out.append((len(g.rows), g.width, [dict(zip(CELL.names, x)) for x in cells]))
    return pd.DataFrame(out, columns=TABLE.names)


# ---- relational plans -----------------------------------------------------------------------
def exploded_tags(df: DataFrame, key: str, otsl: str) -> DataFrame:
    """(key, r, c, tag) of every slot of every rectangle."""
    rows = df.select(F.col(key), F.posexplode(rectangular(tag_rows(F.col(otsl)))).alias("r", "row"))
    return rows.select(key, "r", F.posexplode("row").alias("c", "tag"))


def relational_cells(df: DataFrame, key: str, otsl: str) -> DataFrame:
    """(key, r, c, tag, row_span, col_span) of the owning cells by gaps and islands: a cell
    spans the run of continuation tags up to the next other tag on its row or column."""
    slots = exploded_tags(df, key, otsl)
    along = Window.partitionBy(key, "r").orderBy("c")
    down = Window.partitionBy(key, "c").orderBy("r")
    ahead = lambda w, tags, at: F.min(F.when(~F.col("tag").isin(tags), F.col(at))).over(w.rowsBetween(1, Window.unboundedFollowing))
    slots = (
        slots.withColumn("w", F.max(F.col("c") + 1).over(Window.partitionBy(key)))
        .withColumn("h", F.max(F.col("r") + 1).over(Window.partitionBy(key)))
        .withColumn("next_c", F.coalesce(ahead(along, ["lcel", "xcel"], "c"), "w"))
        .withColumn("next_r", F.coalesce(ahead(down, ["ucel", "xcel"], "r"), "h"))
    )
    return slots.where(F.col("tag").isin("fcel", "ecel")).select(key, "r", "c", "tag", (F.col("next_r") - F.col("r")).alias("row_span"), (F.col("next_c") - F.col("c")).alias("col_span"))


def grid_slots(cells: DataFrame, key: str) -> DataFrame:
    """(key, r, c, origin_r, origin_c): the cell that covers each slot; the last of several wins."""
    covered = (
        cells.withColumn("i", F.explode(F.sequence("r", F.col("r") + F.col("row_span") - 1)))
        .withColumn("j", F.explode(F.sequence("c", F.col("c") + F.col("col_span") - 1)))
        .groupBy(key, F.col("i"), F.col("j"))
        .agg(F.max(F.struct("r", "c")).alias("o"))
    )
    return covered.select(key, F.col("i").alias("r"), F.col("j").alias("c"), F.col("o.r").alias("origin_r"), F.col("o.c").alias("origin_c"))
