"""The text of SQL dumps, cut into statements where nothing is open, in parallel.

Consecutive lines of a file form blocks of about ``BLOCK_CHARS``. Where a block begins in plain text,
in a quote, in a comment or in a dollar-quoted text is told by the blocks ahead of it, so each block is
first taken as a function: for each state it may begin in, the state it ends in, what it does to the
number of open parentheses, and how often quotes stand where no literal can begin or end. Put together
along the file, these give every block's state, for each of two ways to read a backslash:

* ``backslash``: it escapes the next character (MySQL), ``#`` begins a comment, ``--`` only before a space;
* standard: it is a character like any other but in ``E'...'``; ``$tag$...$tag$`` is a text.

A file is read in the way that leaves fewer quotes in the wrong place and nothing open at its end; with
none, by marks that only one of the two has, else with escapes. Blocks are then cut at semicolons, and
at the commas between tuples next to their ends; only what lies between two blocks is joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscrub.session import written_table

BLOCK_CHARS = 1 << 20

# Grammar. Each span ends at its end or, then named, at the end of the block, where it stays open.
_ESCAPED = r"(?:[^{0}\\]++|\\[\s\S]|{0}{0})*+"
_DOUBLED = r"(?:[^{0}]++|{0}{0})*+"
_TAG = r"(?<![\w$])(?P<tag>\$(?:[A-Za-z_]\w*)?\$)"
_LITERAL = rf"'{_ESCAPED.format(chr(39))}(?:'|(?P<single>\Z))", rf"'{_DOUBLED.format(chr(39))}(?:'|(?P<single>\Z))"
_NAMED = rf'"{_ESCAPED.format(chr(34))}(?:"|(?P<double>\Z))', rf'"{_DOUBLED.format(chr(34))}(?:"|(?P<double>\Z))'
_TICKED, _COMMENT = r"`[^`]*+(?:`|(?P<tick>\Z))", r"/\*[\s\S]*?(?:\*/|(?P<comment>\Z))"
_SPANS = {
    False: re.compile("|".join((_LITERAL[0], _NAMED[0], _TICKED, _COMMENT, r"--(?=\s|\Z)[^\n]*", r"\#[^\n]*"))),
    True: re.compile("|".join((
        _LITERAL[0].replace("'", r"(?<![\w$])[eE]'", 1).replace("single", "e"), _LITERAL[1], _NAMED[1], _TICKED, _COMMENT,
        _TAG + r"[\s\S]*?(?:(?P=tag)|(?P<dollar>\Z))", r"--[^\n]*", r"(?m:^[ \t]*\#[^\n]*)"))),
}
_OPEN = {"single": "'", "double": '"', "tick": "`", "comment": "/*", "e": "E'"}
_CLOSE = {
    (False, "'"): re.compile(_ESCAPED.format("'") + "'"), (True, "'"): re.compile(_DOUBLED.format("'") + "'"),
    (False, '"'): re.compile(_ESCAPED.format('"') + '"'), (True, '"'): re.compile(_DOUBLED.format('"') + '"'),
    (True, "E'"): re.compile(_ESCAPED.format("'") + "'"),
}
# A literal (\0) next to a word: no literal begins or ends there.
_FAULT = re.compile(r"\0\w|(?<![\w])[^\W_]\w+\0")
# What only dumps of one kind hold.
_BACKSLASH_MARKS = re.compile(r"`|/\*!|(?i:ENGINE\s*=|AUTO_INCREMENT|LOCK TABLES)")
_STANDARD_MARKS = re.compile(r"\$\$|::|(?i:standard_conforming_strings|PRAGMA|BEGIN TRANSACTION|pg_catalog|\bE'|INTO\s+\")")


class Effect(NamedTuple):
    """What a block does, from one state: the state it ends in; parentheses opened up to the first semicolon
    (None without one) and since the last; quotes and semicolons out of place."""

    end: str
    need: int | None
    depth: int
    faults: int


def _after(text: str, state: str, standard: bool) -> int | None:
    """Where what is open in ``state`` ends; None if the text does not end it."""
    if not state:
        return 0
    if state in ("/*", "`") or state[0] == "$":
        close = "*/" if state == "/*" else state
        at = text.find(close)
        return None if at < 0 else at + len(close)
    found = _CLOSE[standard, state].match(text)
    return found.end() if found else None


def effect(text: str, state: str, standard: bool) -> Effect:
    """What the text does if it begins in ``state``."""
    at = _after(text, state, standard)
    if at is None:
        return Effect(state, None, 0, 0)
    end, parts, start = "", [], at
    for m in _SPANS[standard].finditer(text, at):
        parts.append(text[at:m.start()])
        at, first = m.end(), text[m.start()]
        if m.lastgroup in _OPEN:
            end = _OPEN[m.lastgroup]
        elif m.lastgroup == "dollar":
            end = m["tag"]
        parts.append("\0" if first in "'eE$" else "\1" if first in '"`' else " ")
    plain = "".join(parts) + text[at:]
    faults = len(_FAULT.findall(plain)) + (state in ("'", "E'") and text[start:start + 1].isalnum())
    opened = [p.count("(") - p.count(")") for p in plain.split(";")]
    if len(opened) == 1:
        return Effect(end, None, opened[0], faults)
    return Effect(end, opened[0], opened[-1], faults + sum(x != 0 for x in opened[1:-1]))


def effects(text: str) -> list[dict]:
    """The effects of a block from every state in which it does anything, for both readings."""
    tags = sorted({m[1] for m in re.finditer(r"(?=(\$(?:[A-Za-z_]\w*)?\$))", text)})  # also those that overlap
    closers = {"'": "'", '"': '"', "`": "`", "/*": "*/", "E'": "'", **{t: t for t in tags}}
    out = []
    for standard in (False, True):
        for state in ("", *(s for s, close in closers.items() if close in text and (standard or s != "E'" and s[0] != "$"))):
            out.append({"standard": standard, "state": state, **effect(text, state, standard)._asdict()})
    return out


def _unescaped(text: str) -> str:
    """The content of an E'...' literal as that of a plain one."""
    codes = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
    plain = re.sub(r"\\([\s\S])|''", lambda m: codes.get(m[1], m[1]) if m[1] else "'", text)
    return plain.replace("'", "''")


def cleaned(text: str, state: str, standard: bool) -> tuple[str, str]:
    """The text without comments, its E and dollar literals as plain ones; and as long a text in which all that is
    quoted is masked."""
    out, masks = [], []

    def put(part: str, mask: str | None = None) -> None:
        out.append(part)
        masks.append("x" * len(part) if mask is None else mask)

    def literal(inner: str, kind: str, opened: bool, closed: bool) -> None:
        inner = _unescaped(inner) if kind == "E'" else inner.replace("'", "''")
        put("'" * opened + inner + "'" * closed)

    at = _after(text, state, standard)
    whole = len(text) if at is None else at
    if state == "E'" or state[:1] == "$":
        width = 0 if at is None else 1 if state == "E'" else len(state)
        literal(text[:whole - width], state, False, at is not None)
    elif state == "/*":
        gap = "\n" * text.count("\n", 0, whole)
        put(gap, gap)
    elif state:
        put(text[:whole])
    if at is None:
        return "".join(out), "".join(masks)
    for m in _SPANS[standard].finditer(text, at):
        plain = text[at:m.start()]
        put(plain, plain)
        at = m.end()
        first, closed = m[0][0], m.lastgroup in (None, "tag")
        if standard and first in "eE":
            literal(m[0][2:-1] if closed else m[0][2:], "E'", True, closed)
        elif standard and first == "$":
            literal(m[0][len(m["tag"]):-len(m["tag"])] if closed else m[0][len(m["tag"]):], "$", True, closed)
        elif first in "'\"`":
            put(m[0])
        else:
            gap = " " + "\n" * m[0].count("\n")  # what follows keeps its line
            put(gap, gap)
    put(text[at:], text[at:])
    return "".join(out), "".join(masks)


def safe_points(masked: str, depth: int, end_depth: int) -> tuple[int, int] | None:
    """The ends of the first and the last piece that begins and ends outside parentheses."""
    first = None
    for m in re.finditer(r"[();,]", masked):
        c = m[0]
        depth += (c == "(") - (c == ")")
        if c == ";" or c == "," and depth == 0:
            first = m.end()
            break
    if first is None:
        return None
    at, last = len(masked), first
    while (at := max(masked.rfind(";", 0, at), masked.rfind(",", 0, at))) >= first:
        if masked[at] == ";" or end_depth == masked.count("(", at) - masked.count(")", at):
            last = at + 1
            break
    return first, last


_LINES = "file string, place bigint, text string"
_EFFECT = "struct<standard: boolean, state: string, end: string, need: int, depth: int, faults: int>"
_BLOCK = f"file string, block bigint, places array<bigint>, text string, effects array<{_EFFECT}>, marks int"
_STATE = "file string, block bigint, standard boolean, open boolean, state string, depth int"
_PIECE = "file string, block bigint, seq int, place bigint, text string, standard boolean, kind int, open boolean"
WHOLE, HEAD, TAIL, INNER = 0, 1, 2, 3


def _rows(found: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema=like)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def blocks(lines: DataFrame) -> DataFrame:
    """Blocks of consecutive lines with their effects. ``lines`` (file, place, text) lie in order in each partition."""
    shape, size = _arrow(_BLOCK), BLOCK_CHARS

    def block(file: str, held: list) -> pa.RecordBatch:
        text = "\n".join(t for _, t in held) + "\n"
        marks = len(_BACKSLASH_MARKS.findall(text)) - len(_STANDARD_MARKS.findall(text))
        return _rows([{"file": file, "block": held[0][0], "places": [p for p, _ in held], "text": text, "effects": effects(text), "marks": marks}], shape)

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, held, chars = None, [], 0
        for batch in batches:
            for file, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (file != now or chars >= size):
                    yield block(now, held)
                    held, chars = [], 0
                now = file
                held.append((place, text or ""))
                chars += len(held[-1][1]) + 1
        if held:
            yield block(now, held)

    return lines.mapInArrow(run, _BLOCK)


def states(cut: DataFrame) -> DataFrame:
    """The reading chosen for each file, whether the file ends within a statement, and the state and depth that every
    block begins in. One small row per block is put in order, and held until its file ends."""
    shape = _arrow(_STATE)

    def told(file: str, held: list, now: list, marks: int) -> list[dict]:
        faults = [f + (state != "") + (depth != 0) for state, depth, f in now]
        k = int(faults[1] < faults[0] if faults[0] != faults[1] else marks < 0)
        left = now[k][0] != "" or now[k][1] != 0
        return [{"file": file, "block": block, "standard": bool(k), "open": left, "state": begun[k][0], "depth": begun[k][1]} for block, begun in held]

    def run(batches) -> Iterator[pa.RecordBatch]:
        file, held, now, marks = None, [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != file or not held:
                    if held:
                        yield _rows(told(file, held, now, marks), shape)
                    file, held, now, marks = row["file"], [], [("", 0, 0), ("", 0, 0)], 0
                held.append((row["block"], [x[:2] for x in now]))
                table = {(e["standard"], e["state"]): e for e in row["effects"]}
                for k in (0, 1):
                    state, depth, faults = now[k]
                    if e := table.get((bool(k), state)):
                        cut_ = e["need"] is not None
                        now[k] = (e["end"], e["depth"] + (0 if cut_ else depth), faults + e["faults"] + (cut_ and depth + e["need"] != 0))
                marks += row["marks"]
        if held:
            yield _rows(told(file, held, now, marks), shape)

    slim = cut.select("file", "block", "effects", "marks")
    return slim.repartition("file").sortWithinPartitions("file", "block").mapInArrow(run, _STATE)


def pieces(cut: DataFrame, known: DataFrame) -> DataFrame:
    """Statements, and parts of statements at the ends of blocks, in the reading chosen for the file."""
    shape = _arrow(_PIECE)

    def of_block(row: dict) -> list[dict]:
        text, masked = cleaned(row["text"], row["state"], row["standard"])
        base = {"file": row["file"], "block": row["block"], "standard": row["standard"], "open": row["open"]}
        end_depth = row["depth"]
        for i, part in enumerate(masked.split(";")):
            end_depth = (0 if i else end_depth) + part.count("(") - part.count(")")
        safe = safe_points(masked, row["depth"], end_depth)
        if safe is None:
            return [{**base, "seq": -1, "place": row["places"][0], "text": text, "kind": INNER}]
        first, last = safe
        lines, at = row["places"], first
        line = text.count("\n", 0, first)

        def place() -> int:
            """Of the line in which the next thing after ``at`` stands."""
            lead = len(text) - len(text[at:].lstrip()) if at < len(text) else at
            return lines[min(line + text.count("\n", at, lead), len(lines) - 1)]

        out = [{**base, "seq": -1, "place": lines[0], "text": text[:first], "kind": HEAD}]
        for statement in masked[first:last].split(";"):
            end = min(at + len(statement) + 1, last)
            if text[at:end].strip():
                out.append({**base, "seq": len(out), "place": place(), "text": text[at:end], "kind": WHOLE})
            line += text.count("\n", at, end)
            at = end
        out.append({**base, "seq": 1 << 30, "place": place(), "text": text[last:], "kind": TAIL})
        return out

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for row in batch.slice(i, 1).to_pylist():
                    yield _rows(of_block(row), shape)

    rows = cut.select("file", "block", "places", "text").join(known, ["file", "block"])
    return rows.select("file", "block", "places", "text", "standard", "open", "state", "depth").mapInArrow(run, _PIECE)


def statements(lines: DataFrame, in_order: bool = False) -> DataFrame:
    """(file, block, seq, place, text, standard, open): the statements of dumps, in order of file, block and seq, without
    their comments. ``open`` is true where a file ends within one. A long statement comes in several rows, cut
    between tuples. ``in_order`` says that each partition of ``lines`` (file, place, text) is in order."""
    lines = lines.select("file", "place", "text")
    cut = written_table(blocks(lines if in_order else lines.repartitionByRange("file", "place").sortWithinPartitions("file", "place")), "dump-blocks")
    parts = written_table(pieces(cut, states(cut)), "dump-pieces")
    # what lies between two blocks: the tail of one, blocks without an end of a piece, the head of another
    ahead = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    loose = parts.where(F.col("kind") != WHOLE)
    begins = loose.select("file", "block", "seq", F.coalesce(F.last(F.when(F.col("kind") == TAIL, F.col("block")), True).over(ahead), F.lit(-1).cast("long")).alias("unit"))
    bits = loose.join(begins, ["file", "block", "seq"]).groupBy("file", "unit").agg(
        F.array_sort(F.collect_list(F.struct("block", "seq", "place", "text", "kind"))).alias("bits"), F.first("standard").alias("standard"), F.first("open").alias("open"))
    worded = F.filter("bits", lambda x: F.regexp_like(x["text"], F.lit(r"\S")))
    joined = bits.select(
        "file", F.col("unit").alias("block"), F.lit((1 << 30) + 1).alias("seq"), F.get(worded, F.lit(0))["place"].alias("place"),
        F.array_join(F.col("bits.text"), "").alias("text"), "standard",
        (F.col("open") & (F.element_at("bits", -1)["kind"] != HEAD)).alias("open")).where("place IS NOT NULL")
    whole = parts.where(F.col("kind") == WHOLE).select("file", "block", "seq", "place", "text", "standard", F.lit(False).alias("open"))
    return whole.unionByName(joined)
