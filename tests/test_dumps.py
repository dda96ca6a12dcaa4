"""SQL dumps: how quotes are read, where blocks are cut, and that no row is lost silently."""

import random

import pytest

from sparkscrub.sources import dumptext
from sparkscrub.sources.sqldump import parse_dump

BACKSLASH = ["INSERT INTO t VALUES (1, 'O\\'Hara; \\\\'), (2, 'a''b');", "# it's a note", "INSERT INTO `t` VALUES (3, \"x\\\"y\"), (4, 5--3);",
             "INSERT INTO t VALUES (5, 'n\\nl') ON DUPLICATE KEY UPDATE a = VALUES(a), b = (b);", "INSERT INTO t VALUES (6, 'z');"]
STANDARD = ["INSERT INTO t VALUES (1, 'C:\\'), (2, 'it''s');", "INSERT INTO t VALUES (3, $$it's; ('$$), (4, $q$a $$ b$q$);",
            "INSERT INTO t VALUES (5, E'O\\'Hara\\n'), (6, 'D:\\x\\'); -- it's", "/* don't (", "*/ INSERT INTO \"t\" VALUES (7, 'two", "lines\\'), (8, NULL);"]
WANT = {
    "m.sql": [(1, "O'Hara; \\"), (2, "a'b"), (3, 'x"y'), (4, "5--3"), (5, "n\nl"), (6, "z")],
    "p.sql": [(1, "C:\\"), (2, "it's"), (3, "it's; ('"), (4, "a $$ b"), (5, "O'Hara\n"), (6, "D:\\x\\"), (7, "two\nlines\\"), (8, None)],
}


def dump_of(spark, files):
    lines = [(name, i, text) for name, own in files.items() for i, text in enumerate(own)]
    random.Random(1).shuffle(lines)
    return parse_dump(spark.createDataFrame(lines, "file string, place bigint, text string"))


def items(dump):
    """The values of all rows, in order."""
    return [tuple(int(x.value) if x.kind == "int" else x.value for x in r["items"]) for r in dump.rows.orderBy("_row_index").collect()]


@pytest.mark.parametrize("chars", [1, 40, 1 << 20])
def test_each_file_is_read_in_its_own_way(spark, monkeypatch, chars):
    monkeypatch.setattr(dumptext, "BLOCK_CHARS", chars)
    dump = dump_of(spark, {"m.sql": BACKSLASH, "p.sql": STANDARD})
    assert items(dump) == WANT["m.sql"] + WANT["p.sql"]
    assert dump.bad_rows.collect() == []


def test_what_gives_no_row_is_told(spark):
    files = {
        "open.sql": ["INSERT INTO t VALUES (1, 'a'), (2, 'never", "closed);", "INSERT INTO t VALUES (3, 4);"],
        "cut.sql": ["INSERT INTO t VALUES (5, 6), (7,"],
        "select.sql": ["INSERT INTO t SELECT * FROM u;", "INSERT INTO t VALUES (8, 9)"],
    }
    dump = dump_of(spark, files)
    assert items(dump) == [(5, 6), (1, "a"), (8, 9)]
    bad = {(r.file, r.text) for r in dump.bad_rows.collect()}
    assert {f for f, _ in bad} == {"open.sql", "cut.sql", "select.sql"}
    assert ("cut.sql", "(7,") in bad and ("select.sql", "INSERT INTO t SELECT * FROM u;") in bad
    assert any("never\nclosed" in t and "INSERT INTO t VALUES (3, 4);" in t for _, t in bad)


def test_blocks_put_together_are_the_whole(monkeypatch):
    """The effect of a text is that of its parts, from every state."""
    rng = random.Random(3)
    marks = ["'", '"', "`", "/*", "*/", "--", "#", "\\", "$$", "$a$", "E'", "(", ")", ";", ",", "x", " ", "\n", "''"]
    for _ in range(400):
        lines = ["".join(rng.choice(marks) for _ in range(rng.randrange(8))) + "\n" for _ in range(4)]
        for standard in (False, True):
            state, depth, faults = "", 0, 0
            for line in lines:
                table = {(e["standard"], e["state"]): e for e in dumptext.effects(line)}
                if e := table.get((standard, state)):
                    cut = e["need"] is not None
                    state, depth, faults = e["end"], e["depth"] + (0 if cut else depth), faults + e["faults"] + (cut and depth + e["need"] != 0)
            whole = dumptext.effect("".join(lines), "", standard)
            assert (state, depth) == (whole.end, whole.depth), (lines, standard)
            text, mask = "", ""
            state = ""
            for line in lines:
                a, b = dumptext.cleaned(line, state, standard)
                assert len(a) == len(b)
                text, mask = text + a, mask + b
                state = dumptext.effect(line, state, standard).end
            assert (text, mask) == dumptext.cleaned("".join(lines), "", standard), (lines, standard)


def test_empty_dump(spark):
    dump = dump_of(spark, {"e.sql": ["", "-- nothing", None]})
    assert items(dump) == [] and dump.bad_rows.collect() == [] and dump.tables() == []
