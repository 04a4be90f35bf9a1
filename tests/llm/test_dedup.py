"""SimHash, suffix-array and chunk dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from kpiframe.llm import cdc_dedup as C
from kpiframe.llm import simhash as S
from kpiframe.llm import suffix_dedup as X
from tests.llm.conftest import both, prose


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, near):
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(nodes)):
        for j in range(i):
            if near(nodes[i], nodes[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(nodes))]


def brute_simhash(rows):
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    roots = components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{f:016x}", least.get(r)) for (i, _, _), f, r in zip(rows, fps, roots)), key=str)


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit"
    return " ".join(words)


@pytest.mark.parametrize("tile", [7, S.TILE])
def test_simhash_equals_brute_force(make, awkward, tile):
    rng = random.Random(3)
    base = prose(rng, 400)
    rows = awkward + [(200 + i, edited(rng, base, 1 + i % 4), "a") for i in range(25)]
    got = both(S.near_duplicates(make(rows), tile=tile), "doc_id", "fingerprint", "component_id")
    assert got == brute_simhash(rows)


def test_linked_keeps_components_and_emits_a_forest():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds] + [seeds ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64))
                                              for _ in range(60)]))
    links = S.linked(fps, None)
    assert len(links) < len(fps)
    at = {int(f): i for i, f in enumerate(fps)}
    by_links = components(list(range(len(fps))), lambda i, j: False)
    parent = list(by_links)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in links.tolist():
        ra, rb = root(at[a]), root(at[b])
        parent[max(ra, rb)] = min(ra, rb)
    whole = components([int(f) for f in fps], lambda a, b: (a ^ b).bit_count() <= 4)
    assert [root(i) for i in range(len(fps))] == whole
    half = len(fps) // 2
    across = S.linked(fps[:half], fps[half:])
    assert len(across) < len(fps)


def near_pairs(fps, radius):
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ f) <= radius).tolist():
            yield i, i + 1 + j


def parts(fps, links):
    """For each of the sorted distinct values, the least index that the links reach."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def indices(fps, links):
    return np.searchsorted(fps, np.asarray(links, np.int64).view(np.uint64).reshape(-1, 2)).tolist()


def values_of_bits(rng, places, n):
    """Up to n distinct values that differ in the bits at ``places`` only."""
    bits = rng.integers(0, 2, (n, len(places)), dtype=np.uint64)
    return np.unique((bits << np.array(places, np.uint64)).sum(axis=1, dtype=np.uint64) ^ np.uint64(3 << 62))


def test_comparisons_do_not_grow_with_the_square(monkeypatch):
    rng = np.random.default_rng(4)
    far = np.unique(rng.integers(0, 1 << 64, 40_000, dtype=np.uint64))
    near = far[:300] ^ rng.integers(1, 16, 300, dtype=np.uint64) << np.uint64(29)  # up to four bits
    fps = np.unique(np.concatenate([far, near]))
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(x.size) or count(x))
    links = S.linked(fps, None)
    monkeypatch.undo()
    assert len(links) == len(fps) - len(far)
    assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 4).all()
    assert sum(compared) < 50 * len(fps)


@pytest.mark.parametrize("radius", [0, 1, 4, 9])
def test_buckets_of_any_size_keep_components(radius, monkeypatch):
    # few, some and many to a bucket; spread, alike and repeated
    monkeypatch.setattr(S, "FEW", 16, raising=False)
    monkeypatch.setattr(S, "BLOCK", 32)
    rng = np.random.default_rng(radius)
    rows = [(k, f) for k, places in enumerate([range(64), range(0, 64, 2), range(0, 64, 5), range(8)])
            for f in values_of_bits(rng, places, 700).tolist()] * 2 + [(9, 5), (10, 5)]
    rng.shuffle(rows)
    buckets, values = np.array([k for k, _ in rows]), np.array([f for _, f in rows], np.uint64)
    links = S.linked_in(buckets, values, radius)
    fps = np.unique(values)
    want = [(np.searchsorted(fps, own[i]), np.searchsorted(fps, own[j])) for k in np.unique(buckets)
            for own in [np.unique(values[buckets == k])] for i, j in near_pairs(own, radius)]
    assert parts(fps, indices(fps, links)) == parts(fps, want)
    assert len(links) < len(fps)
    assert S.linked_in(buckets[:0], values[:0], radius).shape == (0, 2)


@pytest.mark.parametrize("places, n, tile", [
    (range(64), 3000, 60), (range(0, 64, 2), 4000, 15), (range(0, 64, 3), 2000, 20), (range(30, 40), 900, 200)])
def test_links_of_tables_that_are_cut_again(spark, places, n, tile):
    rng = np.random.default_rng(n)
    fps = values_of_bits(rng, places, n)
    flip = values_of_bits(rng, [1, 20, 40, 63], 16)
    fps = np.unique(np.concatenate([fps, fps[:40] ^ rng.choice(flip, 40)]))
    pairs = list(near_pairs(fps, 4))
    table = spark.createDataFrame([(f,) for f in fps.view(np.int64).tolist()], "fp long")
    rows = S.bucketed(table, tile=tile).collect()
    buckets = {}
    for r in rows:
        buckets.setdefault(r.bucket, set()).add(r.fp)
    assert max(map(len, buckets.values())) < 4 * tile
    of = {}
    for bucket, members in buckets.items():
        for f in members:
            of.setdefault(f, set()).add(bucket)
    signed = fps.view(np.int64).tolist()
    assert all(of[signed[i]] & of[signed[j]] for i, j in pairs)
    links = [(r.x, r.y) for r in S.fingerprint_links(table.unionAll(table), tile=tile).collect()]
    assert parts(fps, indices(fps, links)) == parts(fps, pairs)


def test_chain_of_links_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 3)], "x long, y long")
    got = {r.node: r.root for r in S.components(chain).collect()}
    assert got == {i: 0 for i in range(61)}
    assert S.components(chain.limit(0)).collect() == []


def test_keep_one_of_each_component(make, awkward):
    rows = [r for r in awkward if r[1] != "another text for the same id"]
    docs = make(rows)
    out = S.keep_one(docs)
    want = brute_simhash(rows)
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect()]
    roots = {r[2] for r in want}
    assert sorted(map(str, got)) == sorted(map(str, roots))


def brute_suffix(rows, n=400):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(t[p:p + n] for _, t in texts for p in range(len(t) - n + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if seen[t[p:p + n]] > 1:
                gone[p:p + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, X.HOT])
def test_suffixes_equal_brute_force(make, awkward, hot):
    rng = random.Random(9)
    passage = prose(rng, 200)[:700]
    rows = [r for r in awkward if r[0] != 13] + [
        (300, prose(rng, 50) + passage + prose(rng, 60), "a"),
        (301, passage[100:560] + prose(rng, 70), "a"),           # overlaps part of the passage
        (302, prose(rng, 10) + passage[:399] + prose(rng, 10), "a"),  # one byte short
        (303, passage[250:] + "|" + passage[:420], "b"),
        (304, "abc" * 300 + prose(rng, 30), "b"), (305, "\0" * 450, "b"),
        (306, "é" * 300 + "x", "b"), (307, prose(rng, 30) + "é" * 250, "b")]
    got = both(X.suffix_report(make(rows), hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_suffix(rows)


def test_long_text_is_cut_into_pieces(monkeypatch):
    rng = random.Random(2)
    text = prose(rng, 3000).encode()
    whole = X.anchors(text)
    monkeypatch.setattr(X, "PIECE", 1000)
    pieces = X.anchors(text)
    assert whole[0].tolist() == pieces[0].tolist() and len(whole[0])
    # every window holds an anchor
    assert max(np.diff(np.concatenate([[-1], whole[0]]))) <= X.LENGTH - X.K + 1


def test_blocks_of_buckets(monkeypatch, make):
    rng = random.Random(4)
    passages = [prose(rng, 150) for _ in range(12)]
    rows = [(i, prose(rng, 20 + i) + passages[i % 12] + prose(rng, 30), "a") for i in range(60)]
    monkeypatch.setattr(X, "BLOCK_ROWS", 8)
    got = both(X.suffix_report(make(rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_suffix(rows)


def test_suffix_dedup_keeps_columns(make, awkward):
    docs = make(awkward)
    out = X.dedup_suffixes(docs)
    assert out.columns == docs.columns
    texts = {(r.doc_id, r.row): r.text for r in out.collect()}
    assert texts[4, "row4"] == "" and texts[1, "row1"] is None and texts[9, "row9"]


def brute_gear(text, mean, least, most):
    h, last, ends = 0, 0, []
    for i, b in enumerate(text):
        h = ((h << 1) + int(C.GEAR[b])) & 0xFFFFFFFF
        if i + 1 - last >= least and h < (1 << 32) // mean or i + 1 - last == most or i + 1 == len(text):
            last = i + 1
            ends.append(last)
    return ends


def test_chunks_equal_rolling_gear():
    rng = random.Random(6)
    for text in (b"", b"a", b"x" * 2000, prose(rng, 500).encode(), bytes(rng.randbytes(5000))):
        assert C.chunk_ends(text) == brute_gear(text, C.MEAN, C.LEAST, C.MOST)


def test_long_text_chunks_in_blocks(monkeypatch):
    text = random.Random(1).randbytes(10000)
    whole = C.chunk_ends(text)
    monkeypatch.setattr(C, "BLOCK", 777)
    assert C.chunk_ends(text) == whole


def test_chunks_resist_an_insertion():
    text = prose(random.Random(8), 2000).encode()
    moved = text[:3000] + b"inserted" + text[3000:]
    cut = lambda t: {t[a:b] for a, b in zip([0, *C.chunk_ends(t)], C.chunk_ends(t))}
    assert len(cut(text) - cut(moved)) <= 6


def brute_matches(texts):
    """{doc: [(start, end)]} over {doc: bytes}: chunks found before, joined while both places
    adjoin, grown a byte at a time."""
    first, out = {}, {}
    for i in sorted(texts):
        text, runs = texts[i], []
        ends = C.chunk_ends(text)
        for a, b in zip([0, *ends], ends):
            at = first.setdefault(text[a:b], (i, a))
            if at == (i, a):
                continue
            j, p = at
            if runs and runs[-1][1] == a and runs[-1][2] == j and runs[-1][3] + a - runs[-1][0] == p:
                runs[-1][1] = b
            else:
                runs.append([a, b, j, p])
        grown = []
        for a, b, j, p in runs:
            other, q = texts[j], p + b - a
            left = right = 0
            while left < min(a, p, C.AROUND) and text[a - left - 1] == other[p - left - 1] \
                    and (i != j or a - left - 1 >= q):
                left += 1
            while b + right < len(text) and q + right < len(other) and right < C.AROUND \
                    and text[b + right] == other[q + right]:
                right += 1
            grown.append((a - left, b + right))
        covered = set()
        for a, b in grown:
            covered |= set(range(a, b))
        spans, last = [], None
        for k in sorted(covered):
            if last is None or k != last + 1 or (k, k) in spans:
                spans.append([k, k + 1])
            spans[-1][1] = k + 1
            last = k
        out[i] = [(a, b) for a, b in spans if b - a >= C.MIN_RUN]
    return out


def test_chunk_dedup_equals_brute_force(make, awkward):
    rng = random.Random(40)
    rows = [r for r in awkward if r[0] is not None and r[0] != 9]
    shared = prose(rng, 90)
    rows += [(200 + i, prose(rng, 30) + shared[rng.randint(0, 60):] + prose(rng, 30), "a") for i in range(4)]
    rows += [(300, "again and again " * 60, "a"), (301, "x" + "again and again " * 20, "a"),
             (302, shared + " " + prose(rng, 5) + " " + shared, "a")]
    texts = {i: (t or "").encode() for i, t, _ in rows}
    want = []
    for i, gone in brute_matches(texts).items():
        text = texts[i]
        kept = b"".join(text[a:b] for a, b in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), len(text)]))
        want.append((i, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    got = both(C.substring_report(make(rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(want, key=str)
    assert {r[0] for r in got if r[2]} >= {5, 6, 8, 201, 202, 203, 300, 302}


def test_passages_of_a_little_over_fifty_words_go(make):
    rng = random.Random(41)
    rows, planted = [], []
    for k in range(120):
        passage = prose(rng, rng.randint(51, 60))
        for i in (2 * k, 2 * k + 1):
            rows.append((i, f"{prose(rng, rng.randint(20, 120))} {passage} {prose(rng, rng.randint(20, 120))}", "a"))
        planted.append((2 * k + 1, len(passage.encode())))
    rows += [(1000 + i, prose(rng, 200), "a") for i in range(60)]
    gone = {r.doc_id: r.n_removed for r in C.substring_report(make(rows)).collect()}
    assert sum(gone[i] >= 0.95 * n for i, n in planted) >= 0.95 * len(planted)
    assert all(gone[i] <= n + 8 for i, n in planted)          # a few bytes that agree by chance
    assert not any(gone[2 * k] for k in range(120)) and not any(gone[1000 + i] for i in range(60))


def test_chunk_dedup_keeps_columns_and_repeated_rows(make, awkward):
    docs = make(awkward)
    out = C.dedup_substrings(docs)
    assert out.columns == docs.columns and out.count() == len(awkward)
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert texts.count((9, "one two")) == 2 and (1, None) in texts


@pytest.mark.parametrize("report", [S.near_duplicates, X.suffix_report, C.substring_report])
def test_empty_table(make, report):
    assert report(make([], 1)).collect() == []
