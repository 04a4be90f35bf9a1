"""Spelling variants, vector codes and exact dedup against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpiframe.llm import exact_dedup as D
from kpiframe.llm import spelling as S
from kpiframe.llm import vector_codes as V
from tests.llm.conftest import prose

# ------------------------------------------------------------------ exact dedup

WHITE = re.compile("[\x20\x09-\x0D]")


def plain_groups(rows):
    """[(doc_id, keep_id, size, digest)] sorted, and how many rows of each group stay."""
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[WHITE.sub("", text or "")].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for s, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), hashlib.sha256(s.encode()).hexdigest()) for m in members]
    return sorted(out, key=str), len(groups)


def check_groups(rows, out):
    out = out.collect()
    want, n_groups = plain_groups(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == want
    kept = [r for r in out if r.kept]
    assert len(kept) == n_groups and len({r.text_sha256 for r in kept}) == n_groups
    assert all(r.doc_id == r.keep_id for r in kept)


COPIES = [(20, "one  two\tthree", "a"), (21, "one two three", "b"), (22, "onetwothree", "a"),
          (23, "onetwothreE", "a"), (24, "one two thre", "a"), (26, " ", "a"),
          (25, " one two three", "a"), (None, " one two\nthree ", "c")]


@pytest.mark.parametrize("slots", [1 << 20, 1])
def test_exact_groups(make, awkward, slots):
    rows = awkward + COPIES
    check_groups(rows, D.exact_report(make(rows), slots=slots))


def test_exact_groups_of_a_common_beginning(make):
    rng = random.Random(3)
    start = "x" * 100
    rows = [(i, start + rng.choice("abc") + " " * rng.randint(0, 2), "a") for i in range(60)]
    check_groups(rows, D.exact_report(make(rows)))
    # rows that are alone by length or beginning have no digest unless it is asked for
    more = rows + [(100, "alone in its length " * 9, "a")]
    by_id = {r.doc_id: r for r in D.exact_groups(make(more)).collect()}
    assert by_id[100].sha is None and by_id[100].kept and by_id[0].sha is not None


def test_exact_empty_table(make):
    assert D.exact_report(make([])).collect() == []
    assert D.drop_copies(make([])).collect() == []


def test_drop_copies_keeps_whole_rows(make, awkward):
    rows = awkward + COPIES
    docs = make(rows)
    out = D.drop_copies(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    want, n_groups = plain_groups(rows)
    assert len(kept) == n_groups
    keepers = {digest: keep for _, keep, _, digest in want}
    for r in kept:
        assert keepers[hashlib.sha256(WHITE.sub("", r.text or "").encode()).hexdigest()] == r.doc_id
        assert r["th"] == f"th{r.doc_id}"


def test_exact_dedup_is_native(make, awkward):
    df = D.exact_report(make(awkward))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------ spelling variants

def plain_counts(rows, slip):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(counts):
    form, near = {}, {}
    for w, n in counts.items():
        close = [(-counts[v], v) for v in counts if one_edit(w, v)]
        near[w] = len(close)
        best = min(close, default=(0, None))
        form[w] = best[1] if best[1] and -best[0] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], counts.get(form[w])))
    return sorted(out)


def variants(words, **options):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n"))
                  for r in S.spelling_variants(words, **options).collect())


def misspelt(seed=11, n=150):
    """Texts over a few hundred words with edits, so that chains of forms arise."""
    rng = random.Random(seed)
    base = [prose(rng, 1) for _ in range(60)] + ["cafés", "naïveté", "×÷ÿÀß", "aaaaa", "aaaaaa"]
    rows = []
    for i in range(n):
        text = []
        for _ in range(80):
            w = rng.choice(base)
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k:],
                                w[:k] + rng.choice("abé") + w[k + 1:]])
            text.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(text) + rng.choice(["", ".", "123"]), "a"))
    return rows


@pytest.mark.parametrize("tile", [1024, 7])
def test_spelling_variants(make, awkward, tile):
    rows = misspelt() + [(i, t, s) for i, t, s in awkward for _ in range(3)]
    counts = plain_counts(rows, 7)
    found = S.word_counts(make(rows), slip=7)
    assert {r.word: r.n for r in found.collect()} == counts
    want = plain_variants(counts)
    assert any(f and r != f for _, f, r, *_ in want)  # a chain of two forms at least
    assert variants(found, tile=tile) == want


def test_long_chain_of_forms(spark):
    words = ["abcdefghij"[:k] + "z" * (10 - k) for k in range(11)]
    rows = [(w, 3 * 4 ** k) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "word string, n long")
    assert variants(df) == plain_variants(dict(rows))
    assert {r.root for r in S.spelling_variants(df).collect()} == {"abcdefghij"}


def test_tied_forms_and_no_words(spark, make):
    rows = [("baaaa", 6), ("caaaa", 6), ("éaaaa", 6), ("aaaa" + "a", 3), ("aaaaaa", 3)]
    df = spark.createDataFrame(rows, "word string, n long")
    assert variants(df) == plain_variants(dict(rows))
    assert variants(S.word_counts(make([]), slip=97)) == []
    assert variants(S.word_counts(make([(1, None, "a"), (2, "", "a"), (3, "one two", "a")]))) == []


def test_very_long_words(spark):
    long = "ab" * 400
    rows = [(long, 9), (long[:-1], 4), (long[:300] + "x" + long[301:], 3), (long + "c", 30), (long[2:], 3)]
    assert variants(spark.createDataFrame(rows, "word string, n long")) == plain_variants(dict(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", min_size=5, max_size=8), min_size=2, max_size=25, unique=True),
       st.booleans())
def test_tile_pairs_find_all_links(words, by_suffix):
    for m in {len(w) for w in words}:
        half = m // 2
        groups = defaultdict(list)
        for w in words:
            if len(w) in (m, m - 1):
                groups[w[-half:] if by_suffix else w[:half]].append(w)
        for members in groups.values():
            raw = [w.encode("latin-1") for w in members]
            x, y = S.compare(raw, raw, m, by_suffix)
            got = {(members[a], members[b]) for a, b in zip(x, y) if a != b}
            want = {(a, b) for a in members for b in members
                    if max(len(a), len(b)) == m and one_edit(a, b)
                    and not (by_suffix and a[:half] == b[:half])}
            assert got == want


# ------------------------------------------------------------------ vector codes

def plain_codes(rows, parts=16, entries=64, rounds=2):
    """{vec_id: (code, error)} and the codebooks, with Python integers."""
    kept = sorted((i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in rows)
    width = len(kept[0][1]) // parts
    cut = [(i, [v[p * width:(p + 1) * width] for p in range(parts)]) for i, v in kept]
    books = [[list(v[p]) for _, v in cut[:entries]] for p in range(parts)]

    def best(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, v in cut:
                mine[best(p, v[p])[1]].append(v[p])
            for k, members in mine.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = {}
    for i, v in cut:
        found = [best(p, v[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, books


def vectors(rng, n, size, spread=0.2):
    return [[rng.choice([0.0, 0.25, -0.125]) + rng.uniform(-spread, spread) for _ in range(size)]
            for _ in range(n)]


def check_codes(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    as_read = {r.vec_id: (r.embedding, r.label) for r in df.collect()}
    good = [(i, v) for i, (v, _) in as_read.items()
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want, books = plain_codes(good)
    out = V.vector_codes(df, **options).collect()
    assert {r.vec_id: (r.code, r.error) for r in out} == want
    by_label = Counter()
    for i, (_, error) in want.items():
        by_label[as_read[i][1]] += error
    assert all(r.label_error == by_label[as_read[r.vec_id][1]] for r in out)
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    assert {r.codebooks_sha256 for r in out} == {hashlib.sha256(text.encode()).hexdigest()}


@pytest.mark.parametrize("size, n", [(64, 150), (48, 90), (16, 100), (80, 20)])
def test_vector_codes(spark, size, n):
    rng = random.Random(size)
    rows = [(i * 3, v, rng.choice([0, 1, 1, 1, None])) for i, v in enumerate(vectors(rng, n, size))]
    rows += [(1, None, 1), (2, [None] + [0.5] * (size - 1), 1), (4, [float("nan")] * size, None),
             (5, [float("inf")] + [0.0] * (size - 1), 0), (7, list(rows[0][1]), 1)]
    check_codes(spark, rows)


def test_vector_codes_of_huge_components(spark):
    rng = random.Random(1)
    rows = [(i, [x * 10 ** rng.choice([0, 6]) for x in v], 1) for i, v in enumerate(vectors(rng, 80, 32))]
    check_codes(spark, rows, "double")


def test_vector_codes_without_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert V.vector_codes(spark.createDataFrame([], kind)).collect() == []
    odd = [(1, None, 1), (2, [], 1), (3, [0.5] * 15, 2)]
    assert V.vector_codes(spark.createDataFrame(odd, kind)).collect() == []


def test_repeated_and_missing_vec_ids(spark):
    rows = [(None, [0.5] * 16, 1), (1, [0.1] * 16, 1), (1, [0.1] * 16, 1), (1, [0.2] * 16, None)]
    out = V.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code[:2]) for r in out.collect()) == [
        (False, 1, "00"), (False, 1, "00"), (False, 1, "02"), (True, 0, "03")]


def test_codes_decode(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors(rng, 40, 32))],
                               "vec_id long, embedding array<double>, label int")
    rows = V.integer_vectors(df)
    books = V.fit_codebooks(rows)
    by_id = {r.vec_id: r.v for r in rows.collect()}
    for r in V.encode(rows, books).collect():
        far = [a - b * 256 for a, b in zip(by_id[r.vec_id], books.decoded(r.code))]
        assert sum(int(x) ** 2 for x in far) == r.error


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 9), st.integers(1, 20), st.integers(1, 12), st.integers(0, 2 ** 32 - 1),
       st.sampled_from([1, 3, 1000, 10 ** 15]))
def test_nearest_is_exact(width, n, k, seed, span):
    rng = random.Random(seed)
    a = [[rng.randint(-span, span) for _ in range(width)] for _ in range(n)]
    e = [[rng.randint(-span, span) for _ in range(width)] for _ in range(k)]
    kind = object if span > V.SMALL else np.int64
    entry, far = V.nearest(V.transformed(np.array(a, kind)), V.transformed(np.array(e, kind)))
    m = 1 << (width - 1).bit_length()
    for row, got, d in zip(a, entry, far):
        best = min((sum((x - y) ** 2 for x, y in zip(row, c)), j) for j, c in enumerate(e))
        assert (d // m, got) == best and d % m == 0


def test_walsh_rows_stand_by_sequency():
    for m in (1, 2, 8, 64):
        h = V.walsh_matrix(m)
        assert (h @ h.T == m * np.eye(m)).all()
        assert [(np.diff(r) != 0).sum() for r in h] == list(range(m))
