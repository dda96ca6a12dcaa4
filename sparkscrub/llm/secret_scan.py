"""Secret scan behind a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived that every text with a
match must meet. The documents are indexed block by block (a block is one Arrow batch): for every
trigram that some query names, the posting list of the block's documents, held as a bitmap. A query
is answered by intersecting and uniting postings, and only the candidates are searched with the
expression. A rule without mandatory trigrams (such as a bare run of hex digits) has no query and
scans every text.

Blocks keep index, query and verification in one task and one pass over the text: nothing is
shuffled, a lost executor costs its blocks only, and memory is bounded by the batch. Only the
trigrams of the queries are indexed; a posting for any other would never be read.

The three base rules (assign, access, hex) always run; further kinds only add spans. Spans are in
code points, end exclusive, leftmost and non-overlapping within a kind. Defined results: a null text
is empty and has no spans; repeated rows are scanned one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as sre, _parser as sre_parser

from pyspark.sql import DataFrame, functions as F

from sparkscrub.llm.common import arrow_map


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression (letters match by ASCII only) and a test of each match."""

    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = lambda m: True


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a maximal run, as matched by one or more and then measured
)

#: What follows the first line of a private key: all up to its last line, or if that is missing, lines of
#: base64 (line ends may be escaped), of which the last may be short.
_KEY_BODY = (r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END (?:[A-Z]{2,12} )?PRIVATE KEY(?: BLOCK)?-----"
             r"|(?:(?:(?:\\[nrt]|[\s>])*+[A-Za-z0-9+/]{16,}+={0,2})++(?:(?:\r?\n|\\n)[A-Za-z0-9+/]{1,15}+={0,2}(?=\s*\n|\\n|\s*\Z))?)?)")

#: Published forms of keys and tokens.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    # a run that no second part follows is passed over whole: none of its other beginnings would fare better
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+(\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,})?", lambda m: m[1] is not None),
    Rule("pem", r"-----BEGIN (?:[A-Z]{2,12} )?PRIVATE KEY(?: BLOCK)?-----" + _KEY_BODY),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%+-]*+:[A-Za-z0-9._~!$&*+,;=%-]++@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES

#: Sets of strings larger than this are cut into trigrams at once.
_MOST_STRINGS = 64


# A query is True (any text), ("tri", t), ("and", parts) or ("or", parts).
def _join(kind: str, parts):
    parts = set(parts)
    if kind == "and":
        parts.discard(True)
    elif True in parts or not parts:
        return True
    if not parts:
        return True
    return parts.pop() if len(parts) == 1 else (kind, frozenset(parts))


def _of_strings(strings):
    """What a text must hold to contain one of the strings."""
    return _join("or", [_join("and", [("tri", s[i:i + 3]) for i in range(len(s) - 2)]) for s in strings])


def _analyse(node):
    """(strings, query) of a parsed expression: all it can match, if that is few, else None; and what else must hold."""
    strings, queries = {""}, []

    def cut():
        queries.append(_of_strings(strings))

    for op, arg in node:
        sub, query = _analyse_one(op, arg)
        queries.append(query)
        if sub is None:
            cut()
            strings = {""}
        elif len(strings) * len(sub) > _MOST_STRINGS:
            cut()
            # the last two characters may still form trigrams with what follows
            strings = {s[-2:] + t for s, t in product(strings, sub)}
            if len(strings) > _MOST_STRINGS:
                strings = {""}
        else:
            strings = {s + t for s, t in product(strings, sub)}
    whole = all(_analyse_one(op, arg)[0] is not None for op, arg in node)
    if whole and len(queries) == len(list(node)):  # never cut: all strings are known
        return strings, _join("and", queries)
    cut()
    return None, _join("and", queries)


def _analyse_one(op, arg):
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN:
        chars = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is sre.SUBPATTERN:
        return _analyse(arg[3])
    if op is sre.BRANCH:
        parts = [_analyse(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), True
        return None, _join("or", [q if s is None else _join("and", [q, _of_strings(s)]) for s, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _analyse(inner)
        if least == 0:
            return (strings | {""}, True) if most == 1 and strings is not None else (None, True)
        if least == most == 1:
            return strings, query
        return None, query if strings is None else _join("and", [query, _of_strings(strings)])
    return None, True


def trigram_query(pattern: str):
    """The Boolean trigram query of an expression, in lower case; True if none is mandatory."""
    strings, query = _analyse(sre_parser.parse(pattern))
    return query if strings is None else _join("and", [query, _of_strings(strings)])


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


def block_index(texts: list[str], wanted: set[str]) -> dict[str, int]:
    """Postings of one block: for each wanted trigram, a bitmap of the texts that hold it in any case."""
    postings = dict.fromkeys(wanted, 0)
    lists: dict[str, list[int]] = {t: [] for t in wanted}
    for i, text in enumerate(texts):
        lower = text.lower()
        for t in wanted:
            if t in lower:
                lists[t].append(i)
    for t, hits in lists.items():
        bits = bytearray(len(texts) // 8 + 1)
        for i in hits:
            bits[i >> 3] |= 1 << (i & 7)
        postings[t] = int.from_bytes(bits, "little")
    return postings


def answer(query, postings: dict[str, int], everything: int) -> int:
    """Bitmap of the texts that meet a query."""
    if query is True:
        return everything
    if query[0] == "tri":
        return postings[query[1]]
    found = everything if query[0] == "and" else 0
    for part in query[1]:
        got = answer(part, postings, everything)
        found = found & got if query[0] == "and" else found | got
    return found


def _positions(bitmap: int):
    data = bitmap.to_bytes((bitmap.bit_length() + 7) // 8, "little")
    return (8 * i + k for i, byte in enumerate(data) if byte for k in range(8) if byte >> k & 1)


def scan_block(texts: list[str | None], rules: tuple[Rule, ...], queries: list) -> list[list[tuple[int, int, int]]]:
    """Spans of each text as (start, end, number of the rule), in order."""
    texts = [t or "" for t in texts]
    everything = (1 << len(texts)) - 1
    postings = block_index(texts, set().union(*map(trigrams, queries)) if queries else set())
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries)):
        find = re.compile(rule.pattern, re.ASCII).finditer
        for i in _positions(answer(query, postings, everything)):
            spans[i] += [(m.start(), m.end(), k) for m in find(texts[i]) if rule.accept(m)]
    return [sorted(s, key=lambda x: (x[0], x[2])) for s in spans]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``found``: an array of (kind, start, end) for every document, empty where nothing is found."""
    kinds, queries = [r.kind for r in rules], [trigram_query(r.pattern) for r in rules]

    def batch(ids, texts):
        spans = scan_block(texts, rules, queries)
        return {"doc_id": ids, "found": [[{"kind": kinds[k], "start": a, "end": b} for a, b, k in s] for s in spans]}

    return arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col)),
                     "doc_id long, found array<struct<kind: string, start: long, end: long>>", batch)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span found replaced by ``mask``; overlapping spans are one."""
    queries = [trigram_query(r.pattern) for r in rules]
    names, at = docs.columns, docs.columns.index(text_col)

    def batch(*columns):
        texts = columns[at]
        out = []
        for text, spans in zip(texts, scan_block(texts, rules, queries)):
            pieces, done = [], 0
            for a, b, _ in spans:
                if a >= done:
                    pieces += [text[done:a], mask]
                done = max(done, b)
            out.append(text if not spans else "".join(pieces) + text[done:])
        return dict(zip(names, [*columns[:at], out, *columns[at + 1:]]))

    return arrow_map(docs, docs.schema, batch)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select("doc_id", *(count(r.kind) for r in BASE_RULES), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))


def digest_of(text: str | None, rules: tuple[Rule, ...] = BASE_RULES) -> str:
    """The base digest of one text, by plain search (used in tests)."""
    spans = sorted((m.start(), k, m.end(), r.kind) for k, r in enumerate(rules)
                   for m in re.finditer(r.pattern, text or "", re.ASCII) if r.accept(m))
    return hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans).encode()).hexdigest()
