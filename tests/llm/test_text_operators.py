"""Toxicity, quality rules, licence scans, HTML extraction and decontamination."""

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from kpiframe.llm import decontaminate as D
from kpiframe.llm import html_extract as H
from kpiframe.llm import licenses as L
from kpiframe.llm import quality as Q
from kpiframe.llm import toxicity as T
from tests.llm.conftest import both, prose

INSULTS = ["grobnik", "pfuijan", "schmutzel", "dolmazo"]


@pytest.fixture(scope="module")
def labelled(spark, make):
    """600 documents, a third of them with insults, most of them labelled."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randint(20, 120)).split()
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), "a"))
        if i % 10:
            labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (9999, 0, 1), (7, 0, None), (8, 1, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, make, labelled):
    rows, labels = labelled
    out = T.score_toxicity(make(rows), labels).collect()
    assert len(out) == 600
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in out if r.held_out or r.doc_id % 10 == 0]
    right = sum(r.predicted == int(r.doc_id % 3 == 0) for r in held)
    assert right / len(held) > 0.97
    toxic = next(r for r in held if r.predicted)
    assert toxic.neighbours[0].label == 1 and toxic.neighbours[0].similarity > 0


def test_toxicity_learns_nothing_from_held_out_labels(spark, make, labelled):
    rows, labels = labelled
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    pick = lambda ls: both(T.score_toxicity(make(rows), ls), "doc_id", "score")
    assert pick(labels) == pick(flipped)


def test_block_max_search_is_exact(spark, make, labelled):
    rows, labels = labelled
    index = T.fit(make(rows), labels)
    memory = {}
    dense = np.zeros((len(index.terms), len(index.ids)))
    for term in range(len(index.terms)):
        for cell in range(index.of_term[term], index.of_term[term + 1]):
            for p in range(index.first[cell], index.first[cell + 1]):
                assert index.examples[p] // T.BLOCK == index.block[cell]
                assert index.weights[p] <= index.most[cell]
                dense[term, index.examples[p]] = index.weights[p]
    assert np.allclose((dense ** 2).sum(axis=0)[dense.any(axis=0)], 1)
    for e in range(0, len(index.ids), 40):
        terms, weights = index.example(e)
        assert np.allclose(dense[terms, e], weights) and len(terms) == np.count_nonzero(dense[:, e])
    for i, text, _ in rows[:150]:
        terms, weights = index.vector(index.counts(T.words(text), memory))
        cosine = weights @ dense[terms] if len(terms) else np.zeros(len(index.ids))
        want = sorted(((-c, e) for e, c in enumerate(cosine) if c > 1e-12))[:T.NEIGHBOURS]
        got = index.nearest(terms, weights)
        assert np.allclose([s for s, _ in got], [-c for c, _ in want])


def test_toxicity_document_frequencies_cover_the_corpus(make, labelled):
    rows, labels = labelled
    more = rows + [(10_000 + i, "grobnik", "z") for i in range(300)]
    a, b = T.fit(make(rows), labels), T.fit(make(more), labels)
    at = a.numbers([b"grobnik"])[0]
    assert at == b.numbers([b"grobnik"])[0] >= 0
    assert b.idf[at] < a.idf[at] and a.numbers([b"nosuchword"])[0] == -1


def test_texts_without_terms_have_no_neighbours(make, labelled):
    rows, labels = labelled
    out = T.score_toxicity(make([(7001, None, "a"), (7002, "", "a"), (7003, " \t\n", None)] + rows), labels)
    found = {r.doc_id: r for r in out.filter("doc_id > 7000").collect()}
    assert len(found) == 3 and len({r.score for r in found.values()}) == 1
    assert all(r.neighbours == [] and r.predicted == 0 for r in found.values())


def test_rare_toxic_texts_and_copies_of_one_are_found(spark, make, labelled):
    """Toxic texts without a word that many toxic examples share: one of a kind that stands
    in 4 examples, and one with many copies, labelled (one example after the near copies)."""
    rng = random.Random(31)
    rows, labels = labelled
    rare, copied = prose(rng, 60), prose(rng, 80)
    rows = rows + [(20_000 + i, " ".join(rng.sample(rare.split(), 50)), "a") for i in range(10)]
    rows += [(30_000 + i, copied, "a") for i in range(60)]
    marked = [(20_000 + i, 1, 1) for i in range(10)] + [(30_000 + i, 1, 1) for i in range(60)]
    labels = labels.unionAll(spark.createDataFrame(marked, labels.schema))
    out = {r.doc_id: r for r in T.score_toxicity(make(rows), labels).collect()}
    held = [r for r in out.values() if r.held_out]
    assert all(r.predicted for r in held if r.doc_id >= 20_000)
    copies = [r for r in held if r.doc_id >= 30_000]
    assert copies and all(r.neighbours[0].similarity > 1 - 1e-9 for r in copies)
    clean = [r for r in held if r.doc_id < 20_000 and r.doc_id % 3]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert any(n.label == 0 for r in clean for n in r.neighbours)       # clean examples are neighbours


def test_toxicity_edge_cases(spark, make, awkward, labelled):
    rows, labels = labelled
    # ids of their own: the labelled rows have the small ones
    odd = [(None if i is None else 7000 + i, t, s) for i, t, s in awkward]
    out = T.score_toxicity(make(odd + rows), labels).filter("doc_id is null or doc_id > 6000")
    found = out.collect()
    assert len(found) == len(odd)
    by_id = {r.doc_id: r for r in found}
    assert by_id[7001].neighbours == [] and by_id[7001].predicted == 0      # NULL text
    assert by_id[7001].score == by_id[7002].score == by_id[7003].score
    none = labels.filter("toxic = 0")
    assert {r.score for r in T.score_toxicity(make(awkward), none).collect()} == {0.0}
    assert T.score_toxicity(make([], 1), labels).collect() == []
    assert T.score_toxicity(make(awkward), labels.limit(0)).count() == len(awkward)


def test_drop_toxic_keeps_columns_and_clean_rows(make, awkward, labelled):
    rows, labels = labelled
    docs = make(rows + [(5000 + i, t, s) for i, t, s in awkward if i is not None])
    out = T.drop_toxic(docs, labels)
    assert out.columns == docs.columns
    scored = {r.doc_id for r in T.score_toxicity(docs, labels).filter("predicted = 0").collect()}
    kept = out.collect()
    assert {r.doc_id for r in kept} == scored
    assert {(r.doc_id, r.row) for r in kept} <= {(i, f"row{i}") for i in scored}


# --- quality ----------------------------------------------------------------------------

def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup,
            len(covered), failed)


def test_quality_counts_equal_brute_force(make, awkward):
    rows = awkward + [(50, "a b c a b c a b c d e f " * 20 + "\nx\nx\n\n \nx", "a"),
                      (51, "## $5 & <b> | 100% *", "a"), (52, "same\n" * 60, "a"), (53, "a b a b a b", "a")]
    got = both(Q.quality_rules(make(rows)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
               "n_repeat_words", "base_failed")
    assert got == sorted(((i, *brute_quality(t)) for i, t, _ in rows), key=str)


def test_compression_bands(make):
    rng = random.Random(3)
    clean = prose(rng, 600)
    noise = " ".join("".join(chr(rng.randint(0x21, 0x7E)) for _ in range(8)) for _ in range(600))
    half = prose(rng, 400) + " " + ("lorem ipsum dolor " * 3 + "sit ").replace("sit", "amet") * 300
    rows = [(1, noise, "a"), (2, half, "a"), (3, None, "a")]
    got = {r.doc_id: r for r in Q.quality_rules(make(rows)).collect()}
    assert not got[1].kept and not got[1].base_failed and got[1].ratio > 0.7
    assert not got[2].kept and not got[3].kept and got[3].base_failed
    zstd = zstandard.ZstdCompressor(level=Q.LEVEL)
    data = clean.encode()
    ratio, chunks, outside, verdict = Q.compression(data, zstd)
    assert ratio == len(zstd.compress(data)) / len(data) and chunks == -(-len(data) // Q.CHUNK)
    low, high = Q.band(len(data))
    assert verdict == (low <= ratio <= high and outside <= Q.CHUNKS_OUTSIDE * chunks)
    assert Q.band(1) == Q.BANDS[0][1:] and Q.band(10 ** 9) == Q.BANDS[-1][1:]
    assert Q.band(512) == Q.BANDS[1][1:]


def test_every_byte_is_in_a_chunk():
    for n in (0, 1, Q.CHUNK - 1, Q.CHUNK, Q.CHUNK + 1, 2 * Q.CHUNK - 1, 2 * Q.CHUNK, 10 * Q.CHUNK + 7):
        starts = Q.chunk_starts(n)
        covered = {k for at in starts for k in range(at, at + Q.CHUNK)}
        assert covered == (set(range(n)) if n >= Q.CHUNK else set())
    rng = random.Random(8)
    # a repetitive tail that does not fill a chunk of its own is judged
    text = prose(rng, 2000).encode()[:Q.CHUNK * 2] + b"again and again " * ((Q.CHUNK - 16) // 16)
    zstd = zstandard.ZstdCompressor(level=Q.LEVEL)
    assert len(text) < 3 * Q.CHUNK
    *_, chunks, outside, _ = Q.compression(text, zstd)
    assert chunks == 3 and outside >= 1


def test_quality_keeps_labelled_good_documents(spark):
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(SF_SMALL.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(SF_SMALL.replace("sf0.001", "sf0.01") + "/labels.parquet")
    out = Q.quality_rules(docs).filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in out}
    assert kept[1] > 0.97 and kept[0] < 0.3


def test_keep_good_keeps_columns(make, awkward):
    docs = make(awkward)
    want = {r.doc_id for r in Q.quality_rules(docs).filter("kept").collect()}
    out = Q.keep_good(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want
    assert Q.quality_rules(make([], 1)).collect() == []


# --- licences ---------------------------------------------------------------------------

def test_patience_alignment():
    a, b = "a b c d e f g".split(), "x a c b d f f g".split()
    pairs = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert [i for i, _ in pairs] == sorted({i for i, _ in pairs})
    assert [j for _, j in pairs] == sorted({j for _, j in pairs})
    assert L.patience(a, a) == [(i, i) for i in range(7)] and L.patience(a, []) == []
    # repeated words are aligned in the gaps between anchors
    assert len(L.patience("the cat the dog the end".split(), "the cat the dog the end".split())) == 6


def test_rising_is_a_longest_subsequence():
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(50):
        ys = rng.sample(range(20), 7)
        got = L._rising(list(enumerate(ys)))
        assert got == sorted(got) and [y for _, y in got] == sorted(y for _, y in got)
        best = max(k for k in range(8) for c in combinations(ys, k) if list(c) == sorted(c))
        assert len(got) == best


def test_licence_scan_finds_edited_and_repeated_texts(make, awkward):
    rng = random.Random(12)
    mit = L.TEMPLATES["MIT"]
    edited = " ".join(w for i, w in enumerate(mit.split()) if i % 12)        # every twelfth word gone
    rows = awkward + [
        (400, prose(rng, 200) + "\nReleased under the MIT license!\n" + prose(rng, 900), "a"),
        (401, prose(rng, 50) + " " + edited + " " + prose(rng, 3000) + " " + mit.upper(), "a"),
        (402, " ".join(w + " " + prose(rng, 40) for w in "Released under the MIT License".split()), "a"),
        (403, "Licensed under CC BY-NC 4.0. All rights reserved.", "a")]
    got = {(r.doc_id, r.license, r.best): r for r in L.scan_licenses(make(rows)).collect()}
    assert {k[:2] for k in got if k[2]} == {(400, "MIT notice"), (401, "MIT"), (403, "CC-BY-NC-4.0 notice"),
                                            (403, "proprietary notice")}
    assert got[400, "MIT notice", True].first_word == 200 and got[400, "MIT notice", True].coverage == 1
    full = [r for r in L.scan_licenses(make(rows)).filter("license = 'MIT'").collect()]
    assert sorted(round(r.coverage, 1) for r in full) == [0.9, 1.0]


def test_licence_prefilter_loses_nothing():
    rng = random.Random(5)
    ready = [L.Template(n, L.words(t), 0.8) for n, t in L.TEMPLATES.items()]
    for t in ready:
        keep = rng.sample(range(len(t.words)), t.needed)
        text = [w for i, w in enumerate(t.words) if i in set(keep)]
        assert not t.marks.isdisjoint(text)
        assert not t.marks.isdisjoint(sorted(t.words, key=lambda w: (len(w), w))[:t.needed])


def plain_matches(template, text):
    """Every window of the greatest length, aligned in full: how many words its best run has."""
    best = 0
    for low in range(max(1, len(text) - template.longest + 1)):
        pairs = L.patience(template.words, text[low:low + template.longest])
        best = max(best, len(pairs))
    return best


def test_licence_scan_equals_an_alignment_of_every_stretch():
    rng = random.Random(17)
    for name in ("MIT notice", "Apache-2.0 notice", "MPL-2.0 header", "Apache-2.0 header"):
        t = L.Template(name, L.words(L.TEMPLATES[name]), 0.8)
        for _ in range(25):
            inside = [w for w in t.words if rng.random() > rng.choice([0, 0.1, 0.3])]
            for _ in range(rng.choice([0, 1, 3])):
                inside.insert(rng.randrange(len(inside) + 1), b"foreign")
            text = L.words(prose(rng, rng.randint(0, 40))) + inside + L.words(prose(rng, rng.randint(0, 40)))
            text += rng.choice([[], rng.sample(t.words, len(t.words) // 2)])     # words out of order
            found = t.matches(text)
            want = plain_matches(t, text)
            # a word more or less, where words that stand twice are anchors in one window only
            assert bool(found) or want <= t.needed, (name, want, t.needed)
            assert not found or want >= t.needed - 1, (name, want, t.needed)
            if found:
                assert max(m[0] for m in found) >= want - 1


def test_licence_words_without_end_take_no_time(make):
    import time

    rng = random.Random(18)
    t0 = time.perf_counter()
    ready = [L.Template(n, L.words(t), 0.8) for n, t in L.TEMPLATES.items()]
    assert L.scan([b"license"] * 20_000, ready) == []
    assert L.scan([b"software", b"the"] * 10_000, ready) == []
    mit = L.words(L.TEMPLATES["MIT"])
    found = L.scan([b"software"] * 10_000 + mit + [b"software"] * 10_000, ready)
    assert [n for n, *_ in found] == ["MIT"] and found[0][2] >= 0.95 * len(mit)
    assert abs(found[0][3] - 10_000) <= 3 and abs(found[0][4] - 10_000 - len(mit)) <= 3
    shuffled = [w for _ in range(40) for w in rng.sample(mit, len(mit))]
    L.scan(shuffled, ready)
    assert time.perf_counter() - t0 < 20


def test_licence_edge_cases(make):
    assert L.scan_licenses(make([], 1)).collect() == []
    with pytest.raises(ValueError):
        L.scan_licenses(make([(1, "x", "a")]), {"empty": " . "})


# --- HTML -------------------------------------------------------------------------------

PAGE = ("<!DOCTYPE html><html lang=en><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script>"
        "</head><body><header><h2>Site</h2></header><nav><ul><li>Menu<li>More</ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><!-- <p>no</p> --><div class=\"ad\">Buy!</div>"
        "<article><h1>{title}</h1><p>First &amp; <b>bold\n\t text</b>&nbsp;{a}<br>line<p>Second 1 < 2 {a}"
        "<div hidden>gone</div><ul><li>one<li>two</ul><section id=comments><p>reader</p></section></article>"
        "<aside>side</aside><form><p>Search</p></form><footer>&copy; foot</footer></body></html>")


def test_main_text_of_a_page():
    text = H.main_text(PAGE.format(title="Head  line", a="x"), set())
    assert text == "Head line\nFirst & bold text x line\nSecond 1 < 2 x\none\ntwo"


@pytest.mark.parametrize("cut", range(0, 700, 7))
def test_pages_cut_off_anywhere(cut):
    page = PAGE.format(title="Head", a="x")
    whole, part = H.main_text(page, set()), H.main_text(page[:cut], set())
    lines = part.split("\n")
    if "<article>" in page[:cut]:
        assert whole.split("\n")[:len(lines) - 1] == lines[:-1]


def test_broken_markup_does_not_fail():
    for page in ("", "<", "<p", "</", "<!--", "<a href='", "<script>x", "<p><b><i>a</p></i>c", "&#x110000;&bogus;x",
                 "<svg><p>in</svg>out", "<table><tr><td>a<td>b<tr><td>c</table>", "a\x00b", "<![CDATA[x]]>"):
        assert isinstance(H.main_text(page, set()), str)
    assert H.main_text("<table><tr><td>a<td>b<tr><td>c</table>", set()) == "a\nb\nc"
    assert H.main_text("<p>plain page</p>text", set()) == "plain page\ntext"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, token string, boilerplate string")


def test_template_blocks_go_and_own_blocks_stay(spark):
    body = "<html><body><div><p>Welcome to our site</p></div><div><p>own text {0}</p><p>more {0}</p></div></body></html>"
    rows = [(i, f"https://user@Host.example:80/p/{i}", body.format(i), "t", "b") for i in range(30)]
    rows += [(100 + i, "http://other.example/", body.format(i), "t", "b") for i in range(3)]
    rows += [(200, None, body.format(1), None, None), (201, "x", None, "t", None), (202, "http://e/", "", None, None)]
    got = {r.page_id: r for r in H.extract_text(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == f"own text {i}\nmore {i}" for i in range(30))
    assert got[100].text == "Welcome to our site\nown text 0\nmore 0"     # too few pages for a template
    assert got[201].text == got[202].text == "" and got[201].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_copies_of_one_page_are_no_template(spark):
    rows = [(i, "http://h.example/a", "<html><body><p>the only article</p></body></html>", None, None)
            for i in range(40)]
    assert {r.text for r in H.extract_text(pages(spark, rows)).collect()} == {"the only article"}


@pytest.mark.parametrize("copies, others", [(40, 4), (200, 90)])
def test_a_page_copied_often_is_no_template(spark, copies, others):
    page = "<html><body><p>every page</p><p>article {0}</p><p>its end {0}</p></body></html>"
    rows = [(i, "http://h.example/a", page.format("copied"), None, None) for i in range(copies)]
    rows += [(1000 + i, "http://h.example/b", page.format(i), None, None) for i in range(others)]
    got = {r.page_id: r.text for r in H.extract_text(pages(spark, rows).repartition(5)).collect()}
    assert {got[i] for i in range(copies)} == {"article copied\nits end copied"}
    assert all(got[1000 + i] == f"article {i}\nits end {i}" for i in range(others))


@pytest.mark.parametrize("block", [
    "<div><a href='/'>Site name</a></div>", "<p><b>Subscribe now</b> to us</p>",
    "<ul><li><span class=x>Item</span></li></ul>", "<p><span><b>deep</b></span></p>"])
def test_template_blocks_that_begin_inline_go(spark, block):
    page = f"outside<html><body>{block}<p><b>Own</b> {{0}}</p></body></html>"
    rows = [(i, "http://h.example/", page.format(i), None, None) for i in range(12)]
    got = {r.page_id: r.text for r in H.extract_text(pages(spark, rows)).collect()}
    assert got == {i: f"Own {i}" for i in range(12)}


def test_the_template_is_a_share_of_the_hosts_pages(spark):
    page = "<html><body><p>{0}</p><p>own {1}</p></body></html>"
    rows = [(i, f"http://{n}.example/", page.format("shared" if i < n else f"other {i}", i), None, None)
            for n in (11, 12) for i in range(20)]
    got = H.templates(pages(spark, rows)).collect()
    assert [(r.t_host, len(r.boilerplate)) for r in got] == [("12.example", 1)]     # 60 % of 20


def test_each_page_type_has_its_template(spark):
    post = "<html><body><div class=post><p>{1}</p><p>text {0}</p></div></body></html>"
    item = ("<html><body><div class=price><p>Free shipping</p>{0} euro</div><p>Seen by others</p>"
            "<div class=note><p>Ask us</p><p>about {0}</p></div></body></html>")
    rows = [(i, "http://h.example/", item.format(i), None, None) for i in range(10)]
    rows += [(100 + i, "http://h.example/", post.format(i, "often told" if i < 10 else f"told {i}"), None, None)
             for i in range(30)]
    got = {r.page_id: r.text for r in H.extract_text(pages(spark, rows)).collect()}
    # a quarter of the host's pages, but all of their type
    assert all(got[i] == f"{i} euro\nabout {i}" for i in range(10))
    assert all(got[100 + i] == f"{'often told' if i < 10 else f'told {i}'}\ntext {i}" for i in range(30))


@pytest.mark.parametrize("moves, gone", [(False, True), (True, False)])
def test_template_text_keeps_its_slot(spark, moves, gone):
    page = "<html><body>{0}<div class=a><p>own {2}</p></div>{1}</body></html>"
    block = "<p>on every page</p>"
    rows = [(i, "http://h.example/", page.format(*(("", block) if moves and i % 2 else (block, "")), i), None, None)
            for i in range(20)]
    got = {r.page_id: r.text for r in H.extract_text(pages(spark, rows)).collect()}
    assert all(("on every page" not in got[i]) == gone and f"own {i}" in got[i] for i in range(20))


def test_page_tokens_are_starts_texts_and_ends():
    page = "<div class=a><p>one<p><b>two</b></div><nav><ul><li>menu</ul></nav><p>end"
    found = H.page_tokens(page)
    assert [t & 3 for t in found] == [2, 0, 0, 3, 1, 3, 0]
    assert found[0] >> 2 == found[3] >> 2 and found[4] >> 2 == found[5] >> 2 != found[0] >> 2


def test_classes_that_cross():
    def events(word, sizes):      # a letter's class, its tokens numbered in order of appearance
        seen: dict = {}
        out = []
        for x in word:
            out.append((0, ord(x), seen.get(x, 0) % sizes[x], sizes[x], {"a": 9, "b": 7, "c": 5}[x]))
            seen[x] = seen.get(x, 0) + 1
        return out
    sizes = {"a": 3, "b": 2, "c": 2}
    assert H.crossed(events("abbacca", sizes)) == set()           # each in one slot
    assert H.crossed(events("abbbba" + "a", sizes)) == set()      # two rounds in a slot
    assert H.crossed(events("abaacbc", sizes)) == {ord("b"), ord("c")}
    assert H.crossed(events("baaab" + "cc", sizes)) == set()      # the larger within the smaller
    assert H.crossed(events("acbcbaa", sizes)) == {ord("c")}


def _random_site(rng, n):
    """Pages of two types with parts that come and go, repeat and move."""
    out = []
    for i in range(n):
        parts = ["<div class=top><p>Welcome</p></div>"] * (rng.random() < 0.9)
        parts += [f"<div class=item><p>Buy</p><p>thing {i} {j}</p></div>" for j in range(rng.randint(0, 3))]
        parts += ["<section id=x><p>one</p><ul><li>two<li>three</ul></section>"] * (i % 3 == 0)
        parts += [f"<p>own {i}</p>", "<div><p>moving</p></div>"]
        if rng.random() < 0.5:
            rng.shuffle(parts)
        out.append(f"<html><body>{''.join(parts)}</body></html>")
    return out + out[:5]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_whole_occurrence_vectors(spark, seed):
    rng = random.Random(seed)
    site = _random_site(rng, 40)
    rows = [(i, f"http://{i % 2}.example/", page, None, None) for i, page in enumerate(site)]
    seqs = H.sequences(pages(spark, rows)).cache()
    classes = H.equivalence_classes(seqs).cache()
    got = {(r.host, r.token): r for r in H.in_order(seqs, classes).collect()}
    keys = {(r.host, r.token): r["class"] for r in classes.collect()}
    for host in ("0.example", "1.example"):
        own = [H.page_tokens(p) for p in {p for i, p in enumerate(site) if f"{i % 2}.example" == host}]
        vectors = {t: tuple(p.count(t) for p in own) for p in own for t in p}
        vectors = {t: v for t, v in vectors.items()
                   if sum(map(bool, v)) >= max(H.MIN_PAGES, H.TYPE_SHARE * len(own))}
        assert {t for h, t in got if h == host} == set(vectors)
        together = {}
        for t, v in vectors.items():
            together.setdefault(v, set()).add(t)
            assert got[host, t].n_pages == sum(map(bool, v)) and got[host, t].distinct_pages == len(own)
        found = {}
        for t in vectors:
            found.setdefault(keys[host, t], set()).add(t)
        assert set(map(frozenset, found.values())) == set(map(frozenset, together.values()))
        # the skeleton of a class that stays together follows in one order, round by round
        skeletons = {}
        for t in vectors:
            if t & 3 != H.TEXT:
                skeletons.setdefault(got[host, t]["class"], []).append(t)
        for members in skeletons.values():
            order = sorted(members, key=lambda t: got[host, t].rank)
            assert [got[host, t].rank for t in order] == list(range(len(order)))
            assert {got[host, t].size for t in order} == {len(order)}
            for p in own:
                kept = [t for t in p if t in set(members)]
                assert kept == order * (len(kept) // len(order))
        # and no element that keeps its place in the whole class was taken out of it
        for tokens_ in together.values():
            marks = {t for t in tokens_ if t & 3 != H.TEXT}
            places = {}
            for p in own:
                for at, t in enumerate(x for x in p if x in marks):
                    places.setdefault(t, set()).add(at % len(marks))
            moved = {t >> 2 for t in marks if len(places[t]) > 1}
            for t in marks:
                assert (got[host, t]["class"] == keys[host, t]) == (t >> 2 not in moved)


def test_a_part_of_a_name_makes_no_furniture(spark):
    cases = {
        "<main><div class='post-with-sidebar'><p>real article text</p></div></main>": "real article text",
        "<div class='article-search-results'><p>body</p></div>": "body",
        "<div class='has-sidebar layout'><main><p>inside</p></main></div>": "inside",
        "<div class='sidebar right'><main><p>inside</p></main><p>beside</p></div>": "inside",
        "<main><p>text</p><div class='comments'><p>nice</p></div></main>": "text",
        "<div><p>text</p><div id='site-header'>name</div><div class='cookie-banner-wrapper'>ok</div></div>":
            "text",
        "<article><header><h1>Title</h1></header><p>text</p></article>": "text",     # as the contract says
        "<div><p>text</p><div class='share-bar'>x</div><div class='comment list'>y</div></div>": "text",
    }
    rows = [(i, f"http://{i}.example/", page, None, None) for i, page in enumerate(cases)]
    got = {r.page_id: r.text for r in H.extract_text(pages(spark, rows)).collect()}
    assert got == dict(enumerate(cases.values()))


def test_very_long_page(spark):
    body = "".join(f"<p>paragraph {i} of the page</p>" for i in range(20_000))
    page = f"<html><body><nav>menu</nav><article>{body}</article><footer>end</footer></body></html>"
    out = H.extract_text(pages(spark, [(1, "http://long.example/", page, None, None)])).first()
    assert out.text == "\n".join(f"paragraph {i} of the page" for i in range(20_000))


def test_extraction_equals_a_plain_reading_of_the_test_pages(spark):
    from tests.conftest import SF_SMALL

    def plain(page):
        found = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
        marked = re.sub(r"<(?!/?[a-zA-Z!])", "\x01", found[1] if found else "")
        marked = re.sub(r"<[^>]*(>|$)", lambda m: " " if re.match(r"</?(b|br)\b", m[0]) else "\x02", marked)
        blocks = (" ".join(html.unescape(b).split()) for b in marked.replace("\x01", "<").split("\x02"))
        return "\n".join(b for b in blocks if b)

    table = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in table.collect()}
    assert {r.page_id: r.text for r in H.extract_text(table).collect()} == want


def test_no_pages(spark):
    assert H.extract_text(pages(spark, [])).collect() == []


# --- decontamination --------------------------------------------------------------------

def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def change(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words.insert(at, b"zusatz")
        elif kind == 1:
            del words[at]
        else:
            words[at] = b"anders"
    return words


def test_window_distance_equals_the_table():
    rng = random.Random(7)
    for _ in range(100):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        assert D.window_distance(np.array(a), np.array(b, int))[0] == brute_distance(a, b)


def test_lsh_reaches_its_recall_and_precision_is_exact():
    rng = random.Random(21)
    items = [(i, D.words(prose(rng, rng.randint(12, 60)))) for i in range(40)]
    matcher = D.Matcher(items)
    texts, planted = [], set()
    for k in range(300):
        i = rng.randrange(len(items))
        d = matcher.radius[i]
        inside = change(rng, items[i][1], rng.randint(0, d))
        around = D.words(prose(rng, rng.randint(0, 100)))
        at = rng.randint(0, len(around))
        texts.append(around[:at] + inside + around[at:])
        planted.add((k, i))
    got = {(t, i): distance for t, i, distance, *_ in matcher.match(texts)}
    assert len(planted & set(got)) / len(planted) >= 0.95
    for (t, i), distance in got.items():
        assert distance == brute_distance(items[i][1], texts[t]) <= matcher.radius[i]


def test_cut_passages_are_found_anywhere_in_a_block():
    """Items without their first or last fifth, or in whole, at the head or the tail of a
    document that is first, between others, or last in its block."""
    rng = random.Random(24)
    for size in (40, 60, 100):
        items = [(i, D.words(prose(rng, size))) for i in range(40)]
        matcher = D.Matcher(items)
        cut = size // 5
        for lost in (slice(cut, None), slice(0, size - cut), slice(0, size)):
            for place in (0, 1, 2):
                found = 0
                for i, ws in items:
                    rest = D.words(prose(rng, 30))
                    text = ws[lost] + rest if lost.start else rest + ws[lost]
                    texts = [D.words(prose(rng, 50)) for _ in range(3)]
                    texts[place] = text
                    found += any((t, k) == (place, i) for t, k, *_ in matcher.match(texts))
                    # and with nothing around it
                    assert {(t, k) for t, k, *_ in matcher.match([ws[lost]])} <= {(0, i)}
                assert found >= 0.95 * len(items), (size, lost, place, found)


def test_contaminated_documents(spark, make, awkward):
    rng = random.Random(22)
    items = [(1, prose(rng, 40)), (2, prose(rng, 15)), (3, ""), (4, None), (None, prose(rng, 20)), (6, "x y")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = awkward + [(500, prose(rng, 500) + " " + items[0][1].upper() + "! " + prose(rng, 20), "a"),
                      (501, items[1][1].replace(" ", ", "), "a"), (501, items[1][1].replace(" ", ", "), "a"),
                      (502, items[4][1], "b"), (503, " ".join(items[0][1].split()[:25]), "b"),
                      (504, "X\ty", "b"), (None, items[1][1], "b")]
    for limit in (D.WORDS_PER_PASS, 30):                     # one pass, and several
        out = D.contaminated(make(rows), benchmark, limit)
        assert both(out, "doc_id", "item_id", "distance") == sorted(
            [(500, 1, 0), (501, 2, 0), (501, 2, 0), (502, None, 0), (504, 6, 0), (None, 2, 0)], key=str)
    found = D.contaminated(make(rows), benchmark).filter("doc_id = 500").first()
    assert (found.first_word, found.end_word, found.similarity) == (500, 540, 1.0)
    kept = D.drop_contaminated(make(rows), benchmark, 30)
    assert kept.columns == make(rows).columns
    assert kept.count() == len(rows) - 6
    assert D.contaminated(make([], 1), benchmark).collect() == []
    assert D.contaminated(make(rows), benchmark.limit(0)).collect() == []
    assert D.drop_contaminated(make(rows), benchmark.limit(0)).count() == len(rows)


def test_matches_do_not_cross_documents():
    rng = random.Random(23)
    item = D.words(prose(rng, 30))
    matcher = D.Matcher([(1, item)])
    assert matcher.match([item[:15], item[15:]]) == []
    assert [m[:3] for m in matcher.match([[], item, []])] == [(1, 0, 0)]
