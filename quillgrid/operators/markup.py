"""Table HTML: normal form, tree, and similarity of predicted and true tables."""

from __future__ import annotations

import html as _html
import re
import unicodedata
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import to_html

_VOID = {"br", "img", "hr", "input", "meta", "link", "col", "wbr"}
_DROPPED = re.compile(r' (?:style|height|width|align|class)=".*?"')
_SMALL = re.compile(r'</?(?:sup|sub|span|div|p)>|<spandata-span-identity="">|<colgroup>.*?</colgroup>')


class _Rewrite(HTMLParser):
    """HTML with th as td, without thead and span tags, and math by its alternative text."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.math = 0

    def handle_starttag(self, tag, attrs, closed=False):
        if tag == "math":
            if not self.math:
                self.out.append(f"${dict(attrs).get('alttext') or ''}$")
            self.math += not closed
        elif not self.math and tag not in ("thead", "span"):
            name = "td" if tag == "th" else tag
            self.out.append(f"<{name}" + "".join(f' {k}="{"" if v is None else _html.escape(v, quote=True)}"' for k, v in attrs) + ("/>" if closed or tag in _VOID else ">"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        if tag == "math":
            self.math = max(0, self.math - 1)
        elif not self.math and tag not in ("thead", "span") and tag not in _VOID:
            self.out.append(f"</{'td' if tag == 'th' else tag}>")

    def handle_data(self, data):
        if not self.math:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def normalize_html(text: str) -> str:
    """The table of a text in normal form with its wrapper; '' if there is none."""
    if "<table" not in text.replace(" ", "").replace("'", '"'):
        return ""
    p = _Rewrite()
    p.feed(text)
    p.close()
    flat = unicodedata.normalize("NFKC", _html.unescape("".join(p.out)).replace("\n", "")).strip()
    inner = "".join(re.findall(r"<table\b[^>]*>(.*)</table>", flat, re.S | re.I))
    inner = re.sub(r"\s+", " ", re.sub(r"</?tbody>", "", _DROPPED.sub("", inner)))
    wrapped = f'<html><body><table border="1" >{inner}</table></body></html>'
    return _SMALL.sub("", wrapped).replace("> ", ">").replace(" </td>", "</td>")


def normal_table(value: str) -> str:
    """Markup or HTML of a table as bare normal HTML; markup is converted first."""
    text = to_html(value) if "<nl>\n" in value else value
    return normalize_html(text).replace('<html><body><table border="1" >', "<table>").replace("</table></body></html>", "</table>")


class Node:
    __slots__ = ("tag", "cols", "rows", "tokens", "children")

    def __init__(self, tag, cols=None, rows=None):
        self.tag, self.cols, self.rows, self.tokens, self.children = tag, cols, rows, [], []


class _Tree(HTMLParser):
    """The first table as a tree that ends at td; tags and single characters are a cell's tokens."""

    def __init__(self, structure_only: bool, ignore: frozenset[str]):
        super().__init__()
        self.structure_only, self.ignore = structure_only, ignore
        self.root, self.stack, self.cell, self.nodes, self.done = None, [], None, 0, False

    def handle_starttag(self, tag, attrs):
        if self.done or tag in self.ignore or (self.root is None and tag != "table"):
            return
        if self.root is None:
            self.root = Node("table")
            self.stack = [self.root]
            return
        self.nodes += 1
        if self.cell is not None and tag != "td":
            self.cell.tokens.append(f"<{tag}>")
            if tag in _VOID:
                self.cell.tokens.append(f"</{tag}>")
            return
        if tag in ("td", "tr"):
            self.cell = None
            while len(self.stack) > 1 and self.stack[-1].tag in (("td",) if tag == "td" else ("td", "tr")):
                self.stack.pop()
        a = dict(attrs)
        num = lambda k: int(a[k]) if str(a.get(k, "")).strip().isdigit() else 1
        node = Node(tag, num("colspan"), num("rowspan")) if tag == "td" else Node(tag)
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)
            self.cell = node if tag == "td" else None

    def handle_endtag(self, tag):
        if self.root is None or self.done or tag in self.ignore or tag in _VOID:
            return
        if self.cell is not None and tag not in ("td", "tr", "table", "tbody"):
            if tag != "unk":
                self.cell.tokens.append(f"</{tag}>")
            return
        if any(n.tag == tag for n in self.stack):
            while self.stack and self.stack.pop().tag != tag:
                pass
            self.cell = None
            self.done = not self.stack

    def handle_data(self, data):
        if self.cell is not None and not self.done and not self.structure_only:
            self.cell.tokens += data


def table_tree(html: str, structure_only: bool = False, ignore: tuple[str, ...] = ()) -> tuple[Node | None, int]:
    """(tree, nodes below the table) of the first table."""
    t = _Tree(structure_only, frozenset(ignore))
    t.feed(html)
    t.close()
    return t.root, t.nodes


def levenshtein(a: list, b: list) -> int:
    """Edit distance of two lists of tokens, by bit vectors (public algorithm)."""
    if a == b:
        return 0
    if not a or not b:
        return max(len(a), len(b))
    at: dict = {}
    for k, t in enumerate(a):
        at[t] = at.get(t, 0) | (1 << k)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for t in b:
        eq = at.get(t, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(d | up)), up & d
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) | 1, minus << 1
        up, down = (minus | ~(d | plus)) & full, plus & d & full
    return score


def _change(a: Node, b: Node) -> float:
    if a.tag != b.tag or a.cols != b.cols or a.rows != b.rows:
        return 1.0
    if a.tag == "td" and (a.tokens or b.tokens):
        return levenshtein(a.tokens, b.tokens) / max(len(a.tokens), len(b.tokens))
    return 0.0


def _post_order(root: Node) -> tuple[list[Node], np.ndarray]:
    """Nodes in post-order and the leftmost leaf of each."""
    nodes, left = [], []

    def walk(n: Node) -> int:
        first = None
        for c in n.children:
            f = walk(c)
            first = f if first is None else first
        nodes.append(n)
        left.append(len(nodes) - 1 if first is None else first)
        return left[-1]

    walk(root)
    return nodes, np.array(left)


def _deep(n: Node) -> tuple:
    return n.tag, n.cols, n.rows, tuple(n.tokens), tuple(map(_deep, n.children))


def _size(n: Node) -> int:
    return 1 + sum(map(_size, n.children))


def tree_distance(a: Node, b: Node) -> float:
    """Ordered tree edit distance with unit insertions and deletions.

    Roots that are equal are matched, and so are the first and the last of their children as
    long as these are equal as a whole: no cheaper edit leaves such apart. Only the rows
    between are compared.
    """
    while not _change(a, b):
        xs, ys = a.children, b.children
        dx, dy = list(map(_deep, xs)), list(map(_deep, ys))
        front, most = 0, min(len(xs), len(ys))
        while front < most and dx[front] == dy[front]:
            front += 1
        back = 0
        while back < most - front and dx[-1 - back] == dy[-1 - back]:
            back += 1
        xs, ys = xs[front : len(xs) - back], ys[front : len(ys) - back]
        if not xs or not ys:
            return float(sum(map(_size, xs)) + sum(map(_size, ys)))
        if len(xs) > 1 or len(ys) > 1:
            a, b = (_with_children(n, c) for n, c in ((a, xs), (b, ys)))
            break
        a, b = xs[0], ys[0]
    return _forest_distance(a, b)


def _with_children(n: Node, children: list[Node]) -> Node:
    out = Node(n.tag, n.cols, n.rows)
    out.tokens, out.children = n.tokens, children
    return out


def _forest_distance(a: Node, b: Node) -> float:
    """The same for any two trees.

    The forest recurrence of Zhang and Shasha (public), a row at a time: insertions are a
    running minimum. Pairs with a leaf have a closed form, so that only pairs of inner
    nodes, the rows of two tables, are worked through.
    """
    na, la = _post_order(a)
    nb, lb = _post_order(b)
    kinds = []
    for nodes in (na, nb):  # equal nodes cost the same: only distinct ones are compared
        at: dict = {}
        place = np.array([at.setdefault((n.tag, n.cols, n.rows, tuple(n.tokens)), len(at)) for n in nodes])
        first = {i: n for n, i in zip(reversed(nodes), place[::-1].tolist())}
        kinds.append((place, [first[i] for i in range(len(at))]))
    (pa, xs), (pb, ys) = kinds
    cost = np.array([[_change(x, y) for y in ys] for x in xs])[pa][:, pb]
    size_a, size_b = np.arange(len(na)) - la + 1, np.arange(len(nb)) - lb + 1
    tree = cost.copy()
    inner_a, inner_b = np.flatnonzero(size_a > 1), np.flatnonzero(size_b > 1)
    for j in inner_b:  # a leaf becomes the node it is nearest to
        tree[:, j] = size_b[j] - 1 + cost[:, lb[j] : j + 1].min(axis=1)
    for i in inner_a:
        tree[i, :] = size_a[i] - 1 + cost[la[i] : i + 1].min(axis=0)
    for i in inner_a:
        for j in inner_b:
            js = np.arange(lb[j], j + 1)
            back, ramp = lb[js] - lb[j], np.arange(len(js) + 1)
            first = lb[js] == lb[j]
            d = np.empty((size_a[i] + 1, len(js) + 1))
            d[0] = ramp
            for x in range(1, size_a[i] + 1):
                ix = la[i] + x - 1
                kept = d[la[ix] - la[i], back] + tree[ix, js]
                if la[ix] == la[i]:
                    kept = np.where(first, d[x - 1, :-1] + cost[ix, js], kept)
                d[x, 0] = x
                d[x, 1:] = np.minimum(d[x - 1, 1:] + 1, kept)
                d[x] = np.minimum.accumulate(d[x] - ramp) + ramp
            tree[i, j] = d[-1, -1]
    return float(tree[-1, -1])


def teds(pred: str | None, true: str | None, structure_only: bool = False, ignore: tuple[str, ...] = ()) -> float:
    """1 - distance / nodes of the larger tree; 0 where either has no table."""
    if not pred or not true:
        return 0.0
    if pred == true and re.search(r"<table\b", pred, re.I):
        return 1.0
    (a, n), (b, m) = table_tree(pred, structure_only, ignore), table_tree(true, structure_only, ignore)
    if a is None or b is None:
        return 0.0
    if not max(n, m):
        return 1.0
    return 1.0 - tree_distance(a, b) / max(n, m)


def teds_udf(structure_only: bool = False, ignore: tuple[str, ...] = ()):
    """(predicted HTML, true HTML) -> similarity; null counts as ''."""

    @F.pandas_udf(T.DoubleType())
    def score(pred: pd.Series, true: pd.Series) -> pd.Series:
        return pd.Series([teds(p, t, structure_only, ignore) for p, t in zip(pred, true)], dtype="float64")

    return score


def _bare(n: Node) -> Node:
    return Node(n.tag, n.cols, n.rows)


def teds_both(pred: str | None, true: str | None) -> tuple[float, float]:
    """(similarity, similarity of the structure alone), each tree being read once."""
    if not pred or not true:
        return 0.0, 0.0
    (a, n), (b, m) = table_tree(pred), table_tree(true)
    if a is None or b is None:
        return 0.0, 0.0
    size = max(n, m)
    if not size:
        return 1.0, 1.0
    # Without content a tree has the same nodes, but no tags within cells.
    (_, n0), (_, m0) = table_tree(pred, True), table_tree(true, True)
    return 1.0 - tree_distance(a, b) / size, 1.0 - tree_distance(_structure(a), _structure(b)) / max(n0, m0, 1)


def _structure(n: Node) -> Node:
    """The tree without the characters of its cells; their tags stay."""
    out = _with_children(_bare(n), list(map(_structure, n.children)))
    out.tokens = [t for t in n.tokens if len(t) > 1]
    return out


@F.pandas_udf(T.StructType().add("teds", T.DoubleType()).add("teds_structure", T.DoubleType()))
def teds_both_udf(pred: pd.Series, true: pd.Series) -> pd.DataFrame:
    """(predicted HTML, true HTML) -> both similarities; null counts as ''."""
    return pd.DataFrame([teds_both(p, t) for p, t in zip(pred, true)], columns=["teds", "teds_structure"], dtype="float64")


def teds_reward(completion: Column, solution: Column, most: int = 30_000) -> Column:
    """Similarity of the tables that a completion and its solution hold, as markup or HTML. Both are cut at
    `most` characters, then the content of <answer> is taken, if there is any; an empty true table gives 0, as nulls do."""
    cut = F.left(F.coalesce(solution, F.lit("")), F.lit(most))
    score = teds_udf()(normal_table_udf(capped(completion, most)), normal_table_udf(capped(solution, most)))
    return F.when(cut == "<table></table>", 0.0).otherwise(score)


@F.pandas_udf(T.StringType())
def normalize_html_udf(text: pd.Series) -> pd.Series:
    return text.map(normalize_html, na_action="ignore")


@F.pandas_udf(T.StringType())
def normal_table_udf(text: pd.Series) -> pd.Series:
    return text.map(normal_table, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def cell_tokens(html: pd.Series) -> pd.Series:
    """Tokens of the cells of the first table: tags whole, characters singly."""
    def of(v):
        root, _ = table_tree(v)
        out = []
        def walk(n):
            out.extend(n.tokens)
            for c in n.children:
                walk(c)
        if root is not None:
            walk(root)
        return out
    return html.map(of, na_action="ignore")


def capped(text: Column, most: int = 30_000) -> Column:
    """What is scored of a text: of its first `most` characters the content of <answer> on one line, or all, ends stripped; '' for null."""
    cut = F.left(F.coalesce(text, F.lit("")), F.lit(most))
    inner = F.when(cut.rlike("<answer>.*?</answer>"), F.regexp_extract(cut, "<answer>(.*?)</answer>", 1)).otherwise(cut)
    return F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StructType().add("cells", T.ArrayType(T.StructType().add("path", T.StringType()).add("cols", T.IntegerType()).add("rows", T.IntegerType()))))
def td_paths(html: pd.Series) -> pd.DataFrame:
    """Child paths and spans of the td nodes of the first table."""
    out = []
    for v in html:
        found: list[dict] = []

        def walk(n: Node, path: str):
            if n.tag == "td":
                found.append({"path": path, "cols": n.cols, "rows": n.rows})
            for k, c in enumerate(n.children):
                walk(c, f"{path}/{k}" if path else str(k))

        root, _ = table_tree(v) if v else (None, 0)
        if root is not None:
            walk(root, "")
        out.append(found)
    return pd.DataFrame({"cells": out})


def span_scores(pred: Column, true: Column) -> list[Column]:
    """SC-TT, SC-TF and SC-F of arrays of (path, cols, rows): spans right (1), of a wrong size
    (0.25) and false (-0.75), each by the number of true spans. No true spans: null; no
    predicted cells: 0; no true cells: -1."""
    spans = lambda c: (c["cols"] > 1) | (c["rows"] > 1)
    truth = F.map_from_entries(F.transform(true, lambda c: F.struct(c["path"], c)))
    graded = F.transform(F.filter(pred, spans), lambda c: F.struct(c.alias("p"), F.try_element_at(truth, c["path"]).alias("t")))
    hit = lambda g: g["t"].isNotNull() & (g["p"]["cols"] == g["t"]["cols"]) & (g["p"]["rows"] == g["t"]["rows"])
    near = lambda g: g["t"].isNotNull() & ~hit(g) & spans(g["t"])
    n_hit, n_near, n = F.size(F.filter(graded, hit)), F.size(F.filter(graded, near)), F.size(graded)
    there = F.nullif(F.size(F.filter(true, spans)), F.lit(0))
    edge = lambda x: F.when(F.size(pred) == 0, 0.0).when(F.size(true) == 0, -1.0).otherwise(x / there)
    return [edge(n_hit * 1.0).alias("sc_tt"), edge(n_near * 0.25).alias("sc_tf"), edge((n - n_hit - n_near) * -0.75).alias("sc_f")]
