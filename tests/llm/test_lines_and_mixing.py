"""Line dedup and mixing: brute force, edge cases, DuckDB."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from kpiframe.llm import line_dedup as L
from kpiframe.llm import mixing as M
from kpiframe.llm.queries import ORACLE, REGISTRY
from tests.conftest import SF_SMALL
from tests.llm.conftest import both

STRIP = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_lines(rows, least=40, docs=5):
    key = lambda line: line.strip(STRIP).translate(LOWER)
    holds = defaultdict(set)
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holds[key(line)].add(i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        gone = [len(holds[key(x)]) >= docs and i != max(
            (d for d in holds[key(x)] if d is not None), default=None) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_equal_brute_force(make, awkward):
    shared = "  This very line stands in MANY documents, É too.\t"
    rows = awkward + [(100 + i, f"own {i}\n{shared}\n{shared.strip().lower().replace('é', 'É')}\nend", "a")
                      for i in range(6)] + [(None, shared, "a"), (103, shared + "\n" + "y" * 40, "b")]
    got = both(L.line_report(make(rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == brute_lines(rows)
    assert sum(r[2] for r in got) > 0


def test_line_bitmaps_are_sparse_words(make):
    line = "a line of more than forty characters, for certain"
    rows = [(i, "\n".join(f"own {i} {k}" for k in range(100)) + "\n" + line, "a") for i in range(5)]
    got = {~r.rd: r.keep for r in L.keep_bitmaps(make(rows)).collect()}
    assert set(got) == {0, 1, 2, 3}                       # the largest doc_id keeps its line
    assert [(w.word, w.bits) for w in got[0]] == [(1, ~(1 << (100 - 64)))]


def test_hot_line_over_many_documents(make):
    line = "the most common line of them all, in every single document"
    rows = [(i, f"{line}\nnumber {i}", "a") for i in range(400)]
    got = both(L.line_report(make(rows, 8)), "doc_id", "n_dropped")
    assert got == sorted(((i, int(i != 399)) for i in range(400)), key=str)


def test_dedup_lines_keeps_columns_and_documents(make, awkward):
    docs = make(awkward)
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(awkward)
    assert both(out, "doc_id", "text", "row") == both(docs, "doc_id", "text", "row")  # nothing repeated


def brute_mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    per = Counter()
    for n, (_, _, s) in zip(size, rows):
        per[s] += n
    names = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = sum(size)
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * per[s] for s in capped)
        target = {s: 3 * per[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = [s for s in free if target[s] > 3 * per[s]]
        if not over:
            return size, per, target
        capped |= set(over)


@pytest.mark.parametrize("drop", [set(), {13}])
def test_mix_equals_brute_force(make, awkward, drop):
    rows = [r for r in awkward if r[0] not in drop]
    size, per, target = brute_mix(rows)
    out = M.mix_report(make(rows)).collect()
    assert sorted(str((r.doc_id, r["size"], r.source_size)) for r in out) == sorted(
        str((i, n, per[s])) for n, (i, _, s) in zip(size, rows))
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    plan = M.mix_plan(make(rows).select("doc_id", "text", "source")).collect()
    for source, goal in target.items():
        mine = [r for r in plan if r.src == source]
        assert all(r.target == pytest.approx(goal) for r in mine)
        if per[source]:
            assert abs(sum(r.taken for r in mine) - goal) <= 1
    again = M.mix_report(make(rows, 7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_positions_follow_the_schedule(make):
    rows = [(i, "word " * 10, "a") for i in range(300)] + [(1000 + i, "word " * 10, "c") for i in range(300)] \
        + [(2000 + i, "word " * 10, "b") for i in range(300)]
    out = M.mix(make(rows))
    got = out.select("source", F.floor(F.col("position_") * 2).alias("half")).collect()
    n = Counter((r.source, r.half) for r in got)
    # half of a falling schedule's tokens is reached before half of the time: 5/8 to 3/8
    assert n["a", 0] / (n["a", 0] + n["a", 1]) == pytest.approx(0.625, abs=0.02)
    assert n["b", 0] / (n["b", 0] + n["b", 1]) == pytest.approx(0.5, abs=0.02)
    assert n["c", 0] / (n["c", 0] + n["c", 1]) == pytest.approx(0.375, abs=0.02)
    at = [r.position_ for r in out.collect()]
    assert at == sorted(at)


def test_schedule_pieces_integrate_and_invert():
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 2.0), (1.0, 0.0))
    pieces = M._pieces(knots)
    assert pieces[0][0] == 0 and pieces[-1][1] == pytest.approx(1)
    with pytest.raises(ValueError):
        M._pieces(((0.0, 0.0), (1.0, 0.0)))


def test_mix_copies_carry_all_columns(make, awkward):
    docs = make(awkward)
    out = M.mix(docs)
    assert out.columns == docs.columns + ["copy_", "words_", "position_"]
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += r.words_
    by_id = Counter()
    for r in M.mix_report(docs).collect():
        by_id[r.doc_id] += r.taken
    assert +words == +by_id


@pytest.mark.parametrize("report", [L.line_report, M.mix_report])
def test_empty_table(make, report):
    assert report(make([], 1)).collect() == []


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_duckdb(spark, key):
    from tests.test_catalog import _canon

    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_SMALL}/{name}.parquet')")
    df = REGISTRY[key](spark, SF_SMALL)
    res = con.execute(ORACLE[key])
    columns, rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(rows, columns)


def test_line_dedup_has_no_python(spark):
    from tools.plan_report import plan_of

    df = REGISTRY["op3_line_dedup"](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    assert not re.search("Python|Pandas|Arrow", plan_of(df))
