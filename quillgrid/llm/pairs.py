"""Defective prompt and response pairs, one defect each.

Prompt and response are aligned: shingles of the response that the prompt contains pick the
possible copies, the longest common subsequence settles them; templates of slots aligned
with each sentence settle refusals. Empty and truncated responses are read off the response
itself and its markup, wrong languages off its sentences, by profiles fitted on documents.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import Profile
from .refusals import is_refusal

# ---- fixed values -------------------------------------------------------------------------
#: What stands for a missing value.
PLACEHOLDERS = {"null", "none", "nil", "nan", "na", "n/a", "n.a.", "#n/a", "empty", "undefined", "missing", "blank", "tbd", "todo"}
#: What may dress a copied question.
COPY_DRESS = re.compile(r"^\s*(?:(?:you\s+(?:asked|ask|said)|user|human|question|prompt|query|q)\s*[:：]|>)\s*", re.I)
#: Words that ask for an answer in a language of its own.
ASKS_LANGUAGE = re.compile(
    r"translat|übersetz|tradui|traduc|traduz|翻译|译成|译为|(?:answer|reply|respond|write|auf|in|en|au|用|以)\s*(?:english|french|german|spanish|chinese|deutsch|englisch|französisch|spanisch|chinesisch|français|francais|anglais|allemand|espagnol|chinois|español|inglés|francés|alemán|chino|英文|英语|法文|法语|德文|德语|西班牙文|西班牙语|中文|汉语)", re.I
)

#: Words that join names.
JOINS = {"and", "or", "und", "oder", "et", "ou", "y", "e", "o", "u", "&", "of", "de", "von", "del", "/", "–"}
#: Sentences around an answer that say nothing of its language.
COURTESY = re.compile(r"^\W*(?:thank you|thanks|sure|of course|certainly|i have read|hope this helps|that is all|end of table|here is|here are|the rows are)\b", re.I)

#: Shingle containment from which a response may be a copy; share of the longer text that the common subsequence covers.
COPY_CONTAINMENT, COPY_LCS = 0.5, 0.88
#: Support by which one language must lead: of a prompt, of a sentence of the response.
PROMPT_LEAD, SENTENCE_LEAD = 3.0, 3.0
#: Words below which a sentence of the response doesn't tell its language.
SENTENCE_WORDS = 4
#: Share of a column's prose that must end with a mark for a missing one to tell; responses that are prose have so many words.
MARKED, PROSE_WORDS = 0.8, 8

_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[㐀-鿿]")
_CONTENT = re.compile(r"[^\W_]|[%‰°€$£¥]")
_FENCE = re.compile(r"```[ \t]*\w*")
_OTSL = re.compile(r"<(nl|fcel|ecel|lcel|ucel|xcel)>")
_END = re.compile(r"(?:[.!?。！？…]|[.!?。！？…]\s*[(（][^()（）]*[)）])[\"'”’»)\]）」』*_`\s]*$")
_OMITTED = re.compile(r"(?:\.\.\.|…|\[truncated\]|<more>|…\(\+\d+\)|�)\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*(?=\S)|\n+")
_QUOTED = re.compile(r"[“„«][^“”„«»]*[”“»]")


def is_empty(response: str | None) -> bool:
    """Null, blank, bare punctuation, containers or markup without content, or a placeholder."""
    if response is None:
        return True
    body = response.strip().strip("()[]{}<>\"'`*_ ").strip().lower()
    if body in PLACEHOLDERS:
        return True
    return not _CONTENT.search(_FENCE.sub("", _TAG.sub("", response)))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors (public algorithm)."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << k)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_by_period(q: str, r: str, times: int) -> int:
    """A common subsequence of `times` times q and r, one q after another: at most the longest."""
    total = at = 0
    for _ in range(times):
        part = r[at : at + len(q)]
        n = lcs(q, part)
        # A slip moves the next period: the end that the most characters of q reach.
        end = max((len(part) - k for k in range(min(len(part), 3))), key=lambda e: (lcs(q, r[at : at + e]) == n, -e)) if n < len(q) else len(part)
        total, at = total + n, at + end
    return total


def is_copy(prompt: str, response: str) -> bool:
    """Whether the response is the prompt, said once or more, with a slip or a dress at most."""
    q = "".join(_WORD.findall(re.sub(r"<image>", " ", prompt).lower()))
    body = response
    while (m := COPY_DRESS.match(body)) and m.end():
        body = body[m.end() :]
    r = "".join(_WORD.findall(re.sub(r"<image>", " ", body).lower()))
    if not q or not r or len(r) < 0.8 * len(q):
        return False
    grams = {q[k : k + 4] for k in range(max(1, len(q) - 3))}
    own = {r[k : k + 4] for k in range(max(1, len(r) - 3))}
    if len(own & grams) < COPY_CONTAINMENT * len(own):
        return False
    times = max(1, round(len(r) / len(q)))
    least = COPY_LCS * max(len(q) * times, len(r))
    if times > 2:
        # Bounds that are linear in the response; only what lies between them needs the whole subsequence.
        if lcs_by_period(q, r, times) >= least:
            return True
        have = Counter(r)
        if sum(min(n * times, have[c]) for c, n in Counter(q).items()) < least:
            return False
    return lcs(q * times, r) >= least


def is_truncated(response: str, profile: Profile, marked: bool = True) -> bool:
    """Whether the response stops within a word, a sentence, or open markup or JSON. Not `marked`: the
    column's sentences don't end with marks, so that only markup, JSON and marks of omission tell."""
    s = response.strip()
    if _OMITTED.search(s) and len(_WORD.findall(s[-400:])) > 3:
        return True
    low = s.lower()
    if low.rfind("<table") > low.rfind("</table"):
        return True
    if re.search(r"</?t?[a-z]{0,4}$", low) and "<table" in low:
        return True
    if low.count("```") % 2:
        return True
    last = None
    for last in _OTSL.finditer(s):
        pass
    if last:
        rest = s[last.end() :]
        if last.group(1) != "nl":
            return True
        s = rest.strip()
        if not s:
            return False
        if s.startswith("<"):
            return True
    if s[:1] in "{[" and not last:
        try:
            json.loads(s)
            return False
        except ValueError:
            opened = s.count("{") + s.count("[") - s.count("}") - s.count("]")
            if opened > 0 or s.count('"') % 2:
                return True
    if low.endswith("</table>") or low.endswith("```") or low.endswith(("</body>", "</html>", "-->")):
        return False
    if _END.search(s):
        return False
    return marked and not is_bare(s, profile)


def is_bare(s: str, profile: Profile) -> bool:
    """A bare value or name: nothing but names, numbers with their units, and what joins them."""
    if s.startswith(("(", "“", '"')) and s.endswith((")", "”", '"')):
        return True
    if _CJK.search(s):
        return len(s) <= 6 and not re.search(r"[，、：；]", s)
    parts = s.split()
    if s.endswith((",", ";", ":", "-")):
        return False
    if len(parts) == 1:
        return len(s) <= 40
    low = [p.strip(".,;:()").lower() for p in parts]
    if low[-1] in profile.common:
        return False
    name = [not p[0].isalpha() or p[0].isupper() and w not in profile.common for p, w in zip(parts, low)]
    if all(n or w in JOINS for n, w in zip(name, low)):
        return len(parts) <= 4 or not re.search(r"\d", s) and any(w in JOINS or p.endswith(",") for p, w in zip(parts, low))
    if parts[0][0].isdigit() and not any(p[0].isdigit() for p in parts[1:]):
        return len(parts) <= 6  # an amount and what it is of
    if len(parts) > 4:
        return False
    # A unit after its number.
    return all(n or k and parts[k - 1][-1].isdigit() and w not in profile.common for k, (n, w) in enumerate(zip(name, low)))


def other_language(prompt: str | None, response: str, profile: Profile) -> bool:
    """Whether the response has sentences in another language than the prompt's and none in it;
    tables, JSON, quotations and courtesies are set aside. Not where the prompt asks for it."""
    if not prompt or ASKS_LANGUAGE.search(prompt):
        return False
    s = response.strip()
    if s[:1] in "{[":
        return False
    if "<" in s:
        s = re.sub(r"<table.*?</table>", "\n", s, flags=re.S | re.I)
        s = "\n".join(x for x in s.split("\n") if not _OTSL.search(x))
    asked = profile.of(prompt.replace("<image>", " "), PROMPT_LEAD)
    if asked is None:
        return False
    told = False
    sentences = [x for x in _SENTENCE.split(_QUOTED.sub(" ", s)) if x.strip() and not COURTESY.search(x)]
    for x in sentences:
        found = profile.of(x, SENTENCE_LEAD, SENTENCE_WORDS)
        if found == asked:
            return False
        told |= found is not None
    # Sentences that don't tell on their own may do so together.
    return told or profile.of(" ".join(sentences), SENTENCE_LEAD, SENTENCE_WORDS) not in (None, asked)


def defect(prompt: str | None, response: str | None, profile: Profile, marked: bool = True) -> str | None:
    """The pair's defect, or None. A null or blank prompt can be neither copied nor spoken to in another language."""
    if is_empty(response):
        return "empty"
    if is_refusal(response):
        return "refusal"
    if prompt and prompt.strip() and is_copy(prompt, response):
        return "copy"
    if is_truncated(response, profile, marked):
        return "truncated"
    return "language" if other_language(prompt, response, profile) else None


def marked_column(df: DataFrame, response: str) -> bool:
    """Whether the column's prose ends with marks, so that a missing one tells. All rows are counted."""
    text = F.rtrim(F.col(response))
    prose = (F.size(F.split(text, r"\s+")) >= PROSE_WORDS) & ~F.substring(text, 1, 1).isin("{", "[", "<", "`", "|")
    n, ended = df.where(prose).agg(F.count("*"), F.count_if(text.rlike(r"[.!?。！？…>}\])”\"'`*|]$"))).first()
    return not n or ended >= MARKED * n


def defective_pairs(df: DataFrame, key: str, prompt: str, response: str, profile: Profile) -> DataFrame:
    """(id, defect), one row for each defective pair of `df`.

    `profile`: fitted languages; with an empty one only scripts tell languages apart. Null
    and empty responses are 'empty'. A pair of several defects has the first of empty,
    refusal, copy, truncated, language; of the rows of a key that comes again the first such
    by name counts. In a column whose prose mostly ends without a mark, a missing one is no
    defect. A null or blank prompt can be neither copied nor spoken to in another language.
    An empty table gives no rows; other columns are ignored; whole texts are read, however long.
    """
    rows = df.select(F.col(key).alias("id"), F.col(prompt).alias("prompt"), F.col(response).alias("response"))
    marked = marked_column(rows, "response")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [defect(p, r, profile, marked) for p, r in zip(b.column("prompt").to_pylist(), b.column("response").to_pylist())]
            out = pa.record_batch([b.column("id"), pa.array(found, pa.string())], names=["id", "defect"])
            yield out.filter(out.column("defect").is_valid())

    return rows.mapInArrow(scan, f"id {dict(rows.dtypes)['id']}, defect string").groupBy("id").agg(F.min("defect").alias("defect"))
