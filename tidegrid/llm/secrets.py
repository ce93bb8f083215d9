"""Secret scans through a trigram index.

Each rule is a regular expression. From its parse tree follows a Boolean query
over trigrams that every match must contain, in lower case. Each bounded piece
of texts gets an inverted index, restricted to the trigrams any rule asks for:
posting lists of text numbers. AND intersects and OR unites them; only the
candidates are searched with the expression itself. A rule without mandatory
trigrams (plain hexadecimal runs) searches every text. Pieces are independent,
so a lost task is simply run again and memory stays bounded.

Defined results: a null text counts as empty; matches of one kind do not
overlap (leftmost first), those of different kinds may; positions are code
points, ends exclusive; repeated rows are each answered.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as node
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MOST_STRINGS = 64  # alternatives followed through a concatenation; beyond them the query only gets weaker


@dataclass(frozen=True)
class Rule:
    """``group`` must have at least ``least`` characters, else the match is dropped (it still consumes its text)."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ that reach 24 characters
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("live_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_password", r"://[^\s:/@]{1,64}:[^\s:/@]{3,128}@[A-Za-z0-9]"),
    Rule("bearer", r"authorization: bearer [A-Za-z0-9._~+/-]{20,}", True),
)
RULES = BASE + ADDED

# A query is True (no demand), a trigram, or ("and" | "or", parts).


def trigram_query(rule: Rule):
    """The trigrams, in lower case, that every match of a rule must contain."""
    strings, demands = _sequence(_parser.parse(rule.pattern))
    return _all([*demands, _strings(strings)])


def _sequence(items):
    """Strings that the end of a concatenation may spell, and the demands of what came before."""
    ends, demands = {""}, []

    def cut():
        nonlocal ends
        demands.append(_strings(ends))
        ends = {""}

    for op, arg in items:
        options = _spelled(op, arg)
        if options is not None and len(options) * len(ends) <= MOST_STRINGS:
            ends = {a + b for a in ends for b in options}
            continue
        cut()
        if op is node.SUBPATTERN:
            inner, more = _sequence(arg[3])
            demands += [*more, _strings(inner)]
        elif op is node.BRANCH:
            parts = [_sequence(branch) for branch in arg[1]]
            demands.append(_any([_all([*more, _strings(inner)]) for inner, more in parts]))
        elif op in (node.MAX_REPEAT, node.MIN_REPEAT) and arg[0] > 0:
            inner, more = _sequence(arg[2])
            demands += [*more, _strings(inner)]
    return ends, demands


def _spelled(op, arg) -> set[str] | None:
    """All strings a part matches, in lower case, if they are few and known."""
    if op is node.LITERAL:
        return {chr(arg).lower()}
    if op is node.IN and all(k is node.LITERAL for k, _ in arg):
        return {chr(c).lower() for _, c in arg}
    if op is node.SUBPATTERN:
        ends, demands = _sequence(arg[3])
        return None if demands else ends
    if op is node.BRANCH:
        parts = [_sequence(branch) for branch in arg[1]]
        return None if any(more for _, more in parts) else set().union(*(ends for ends, _ in parts))
    if op in (node.MAX_REPEAT, node.MIN_REPEAT):
        low, high, inner = arg
        ends, demands = _sequence(inner)
        if demands or high is node.MAXREPEAT or high > 4 or len(ends) ** int(high) > MOST_STRINGS:
            return None
        return {"".join(x) for n in range(low, high + 1) for x in itertools.product(ends, repeat=n)}
    return None


def _strings(options):
    return _any([_all([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(options)])


def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Scanner:
    """The rules, their queries, and the table that finds the trigrams they ask for."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = [(r, r.compiled(), trigram_query(r)) for r in rules]
        asked = sorted(set().union(*(trigrams(q) for _, _, q in self.rules)))
        self.number = {t: i + 1 for i, t in enumerate(asked)}
        self.wanted = np.zeros(1 << 24, dtype=np.uint8 if len(asked) < 256 else np.uint16)
        for t, i in self.number.items():
            a, b, c = t.encode("latin-1")
            self.wanted[a << 16 | b << 8 | c] = i

    def index(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """Posting lists by trigram number: the texts, ascending, that hold the trigram in any case."""
        joined = np.frombuffer(b"\0".join(t.lower() for t in texts) + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        met = self.wanted[joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]]
        at = np.flatnonzero(met)
        pairs = np.unique(met[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        cuts = np.searchsorted(pairs, np.arange(len(self.number) + 2) * len(texts))
        return [pairs[a:b] - i * len(texts) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    def candidates(self, query, postings, count: int) -> np.ndarray:
        if query is True:
            return np.arange(count)
        if isinstance(query, str):
            return postings[self.number[query]]
        parts = [self.candidates(q, postings, count) for q in query[1]]
        if query[0] == "and":
            return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(parts, key=len))
        return reduce(np.union1d, parts)

    def scan(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, str]]]:
        """Per text its spans (start, end, kind), by start and then by the order of the rules."""
        texts = [t or "" for t in texts]
        found: list[list] = [[] for _ in texts]
        if not texts:
            return found
        postings = self.index([t.encode() for t in texts])
        for k, (rule, expression, query) in enumerate(self.rules):
            for i in self.candidates(query, postings, len(texts)).tolist():
                for m in expression.finditer(texts[i]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [[(a, b, self.rules[k][0].kind) for a, k, b in sorted(f)] for f in found]


SPANS = "secrets array<struct<kind:string,start:int,stop:int>>"


def find(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Append ``secrets``: the spans of every whole text, by start, then in the order of the rules."""
    def make():
        scanner = Scanner(rules)

        def each(texts):
            return [[[{"kind": k, "start": a, "stop": b} for a, b, k in f] for f in scanner.scan(texts.to_pylist())]]
        return each

    return map_texts(docs, text, SPANS, make)


def redact(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, mask: str = "[REDACTED]") -> DataFrame:
    """Replace every span (overlapping ones together) by ``mask``; all other columns and rows stay as they are."""
    schema = docs.schema
    at = schema.names.index(text)

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            columns = list(batch.columns)
            columns[at] = pa.array([masked(t, f, mask) for t, f in zip(texts, scanner.scan(texts))], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def masked(text: str | None, spans, mask: str) -> str | None:
    if not spans:
        return text
    out, at = [], -1
    for a, b, _ in spans:
        if a >= at:
            out += [text[max(at, 0):a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(found: DataFrame, doc_id: str = "doc_id", base: Sequence[Rule] = BASE) -> DataFrame:
    """The result rows of the query: counts per base kind, a digest of the base spans, all spans as text."""
    kinds = [r.kind for r in base]
    written = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    of = lambda *k: F.filter("secrets", lambda x: x["kind"].isin(*k))
    return found.select(F.col(doc_id), *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
                        F.sha2(written(of(*kinds)), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))
