"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams: text that
matches must hold certain trigrams, in all of some groups, in one of others. Documents are
indexed in segments (up to 1,024 documents each): for every trigram that some query mentions, a
posting list of the segment's documents that hold it. A query is answered by intersecting and
uniting postings; only the documents left are verified with the rule's expression over the
whole text. A rule from which no mandatory trigram follows (runs of hex digits) scans every
document of the segment.

Segments are built where the rows are read, so nothing is shuffled and no key can be hot; the
index holds only trigrams that occur in rules, so its size doesn't depend on the texts.

Trigrams are taken from the text with A-Z lower-cased: for rules that heed case the query is
then wider, never narrower.

Defined cases: null and empty text have no spans; repeated rows each give their own row; very long texts are
scanned whole; spans that begin together come in the order of the rules; an empty table gives no rows;
extra columns are ignored. Positions are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` count if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


def _either_case(words: str) -> str:
    """ASCII letters in either case, spelt out: a flag would let other scripts' letters in."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


BASE = (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Characters of a private key's body at most, between its two marks.
_BODY = 16_384
#: What stands around the lines of a key that is quoted in a mail, a source string or a comment: white space and escapes of it,
#: quotes, marks of quoting, and a plus that joins strings.
_AROUND = r"""(?:[\s"'`>|#*,;()]|\\[nrt]|\\|\+(?=[\s"'`]))*"""
_HEADER = r"""(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID|Key-Type|X-[A-Za-z-]+): ?[^\n\r\\"'`]*"""
_MARK = "[A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
#: Spans besides the base ones. A private key is its marks and all between them. Where the end mark is missing, its header lines
#: and its lines of base64 belong to it, up to a last one that is short and padded or holds a digit.
MORE = (
    Rule(
        "private_key",
        r"-----BEGIN " + _MARK
        + r"""(?:(?:(?!-----BEGIN )[A-Za-z0-9+/=\s\\:,."'`>|#*;()_-]){0,%d}?-----END """ % _BODY + _MARK
        + rf"|(?:{_AROUND}(?:{_HEADER}|[A-Za-z0-9+/]{{40,}}={{0,2}}))*(?:(?<=[A-Za-z0-9+/=]){_AROUND}(?<![A-Za-z0-9+/=])(?:=[A-Za-z0-9+/]{{4}}|[A-Za-z0-9+/]+={{1,2}}|(?=[A-Za-z]*[0-9+/])[A-Za-z0-9+/]{{4,39}})(?![A-Za-z0-9+/=]))?)",
        0,
        1,
    ),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
RULES = BASE + MORE
#: Documents of a segment at most.
SEGMENT = 1024

# --- Boolean trigram queries -------------------------------------------------------------
# A query is True (anything may match), a trigram, ("and", queries) or ("or", queries).
_MOST = 16


def _all(parts: list) -> object:
    flat = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _any(parts: list) -> object:
    flat = list(dict.fromkeys(parts))
    return True if True in flat or not flat else flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _of(strings: set[str]) -> object:
    """The query for texts that hold one of the strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _analyse(tree) -> tuple[set[str] | None, object]:
    """(all strings that the expression can match, or None if too many; query)."""
    run: set[str] = {""}  # what the parts since the last break can match
    found: list = []
    whole = True
    for code, arg in tree:
        some, query = _part(code, arg)
        found.append(query)
        if some is not None and len(some) * len(run) <= _MOST:
            run = {a + b for a in run for b in some}
        else:
            found.append(_of(run))
            run, whole = some if some is not None else {""}, False
    return (run, _all(found)) if whole else (None, _all([*found, _of(run)]))


def _part(code, arg) -> tuple[set[str] | None, object]:
    if code is op.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}, True
    if code is op.IN:
        return _members(arg), True
    if code is op.SUBPATTERN:
        return _analyse(arg[3])
    if code is op.BRANCH:
        sides = [_analyse(x) for x in arg[1]]
        listed = all(s is not None for s, _ in sides) and sum(len(s) for s, _ in sides) <= _MOST
        return set().union(*(s for s, _ in sides)) if listed else None, _any([_all([q, _of(s) if s is not None else True]) for s, q in sides])
    if code in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, body = arg
        inner, query = _analyse(body)
        if (low, high) == (1, 1):
            return inner, query
        if (low, high) == (0, 1) and inner is not None:
            return inner | {""}, True
        return None, _all([query, _of(inner) if inner is not None else True]) if low else True
    return ({""} if code is op.AT else None), True


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for code, arg in items:
        if code is op.LITERAL:
            out.add(chr(arg).lower() if arg < 128 else chr(arg))
        elif code is op.RANGE and arg[1] - arg[0] < _MOST:
            out.update(chr(x).lower() if x < 128 else chr(x) for x in range(arg[0], arg[1] + 1))
        else:
            return None
    return out if len(out) <= _MOST else None


def trigram_query(pattern: str) -> object:
    """The Boolean query over lower-cased trigrams that every match of the pattern satisfies."""
    exact, query = _analyse(parser.parse(pattern))
    return _all([query, _of(exact)]) if exact is not None else query


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Segment:
    """Posting lists of one batch of texts for the trigrams given."""

    def __init__(self, texts: list[str], wanted: set[str]):
        self.size = len(texts)
        low = [x.encode("utf-8", "surrogatepass").lower() for x in texts]  # bytes: only A-Z change
        self.postings = {t: np.array([i for i, x in enumerate(low) if t.encode() in x], dtype=np.int64) for t in sorted(wanted)}

    def candidates(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        found = self.candidates(query[1][0])
        for part in query[1][1:]:
            found = (np.intersect1d if query[0] == "and" else np.union1d)(found, self.candidates(part))
        return found


def scan_texts(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) of each text, by start, then in the order of the rules."""
    ready = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
    segment = Segment(texts, set().union(*(trigrams(q) for _, _, q in ready)))
    out: list[list] = [[] for _ in texts]
    for n, (rule, pattern, query) in enumerate(ready):
        for i in segment.candidates(query).tolist():
            for m in pattern.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), n, rule.kind, m.end()))
    return [[(kind, a, b) for a, _, kind, b in sorted(spans)] for spans in out]


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.pandas_udf(_SPANS)
def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        found = [x for at in range(0, len(texts), SEGMENT) for x in scan_texts(["" if x is None else x for x in texts.iloc[at : at + SEGMENT]])]
        yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found], dtype=object)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end>>."""
    return docs.select(F.col(doc_id).alias("doc_id"), _scan(F.col(text)).alias("spans"))


def redact_text(text: str | None, rules: tuple[Rule, ...] = RULES) -> str | None:
    """The text with each secret (a rule's group) replaced by ``[REDACTED]``."""
    if not text:
        return text
    return _redacted(text, scan_texts([text], rules)[0])


def _redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    by_kind = {r.kind: r for r in RULES}
    holes = []
    for kind, a, b in spans:
        rule = by_kind[kind]
        if rule.group:  # only the value goes, its name stays
            m = re.compile(rule.pattern).match(text, a)
            a, b = m.start(rule.group), m.end(rule.group)
        holes.append((a, b))
    out, at = [], 0
    for a, b in sorted(holes):
        if b <= at:
            continue
        out += [text[at : max(a, at)], "[REDACTED]" if a >= at else ""]
        at = b
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def _redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        found = [x for at in range(0, len(texts), SEGMENT) for x in scan_texts(["" if x is None else x for x in texts.iloc[at : at + SEGMENT]])]
        yield pd.Series([_redacted(x, spans) if spans else x for x, spans in zip(texts, found)], dtype=object)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the secrets in their texts replaced; other columns stay."""
    return docs.withColumn(text, _redact(F.col(text)))


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def brute_force(text: str | None) -> tuple[str, str]:
    """(base digest, all spans) of one text without the index, for tests."""
    spans = []
    for n, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                spans.append((m.start(), n, f"{rule.kind}:{m.start()}:{m.end()}"))
    spans.sort()
    base = ",".join(x for _, n, x in spans if n < len(BASE))
    return hashlib.sha256(base.encode()).hexdigest(), ",".join(x for *_, x in spans)
