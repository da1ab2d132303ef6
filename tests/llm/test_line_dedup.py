import re
from collections import defaultdict

from edgeloom.llm.line_dedup import line_dedup

from .helpers import LONG, corpus

COMMON = "A line that many of the documents share"


def brute(rows, min_docs=3, min_chars=20):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, stage):
    rows = [
        (1, f"{COMMON}\nown one\n{COMMON.upper()}"), (2, f"\t{COMMON} \nown two"), (3, COMMON), (4, f"x\n\n{COMMON}\x0b\ny\n"), (5, None), (6, ""), (7, "\n\n"),
        (8, "ÄÖÜ äöü only here and in two more 1"), (9, "äöü äöü only here and in two more 1"), (10, "ÄÖÜ ÄÖÜ only here and in two more 1"), (11, "short\nshort"), (12, "short"), (13, "short"),
        (14, LONG + "\n" + COMMON), (None, COMMON), (15, COMMON), (15, COMMON), (15, f"other\n{COMMON}"), (16, "\r\n".join([COMMON] * 3)),
    ]
    out = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup(corpus(spark, rows), stage).collect()]
    assert sorted(out, key=repr) == brute(rows)


def test_long_document_of_shared_lines(spark, stage):
    lines = "\n".join(f"shared line number {i} of a long list" for i in range(20_000))
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.text == lines) for r in line_dedup(corpus(spark, [(i, lines) for i in range(3)]), stage).collect()}
    assert out == {0: (20_000, 20_000, False), 1: (20_000, 20_000, False), 2: (20_000, 0, True)}


def test_empty_table_and_clashing_columns(spark, stage):
    docs = corpus(spark, [(1, "a")]).selectExpr("*", "'x' AS n_lines", "1 AS key", "2 AS hash", "3 AS keeper", "4 AS place")
    row = line_dedup(docs, stage).collect()[0]
    assert (row.n_lines, row.n_dropped, row.key, row.hash, row.keeper, row.place) == (1, 0, 1, 2, 3, 4)


def test_no_rows(spark, stage):
    assert line_dedup(corpus(spark, []), stage).count() == 0
