"""Toxicity scores from the nearest labelled examples.

Texts are TF-IDF vectors over the words of the labelled examples; words that tell toxic
examples from the others by chi-square weigh more. For each text the nearest
labelled examples by exact cosine are found in an inverted index whose postings are cut into
blocks of examples, each with the largest weight it holds per term: blocks are visited in
order of the bound these give, until no bound can beat the k-th best. Distance-weighted votes
of the neighbours, calibrated on left-out votes, are the score; the neighbours are its
evidence.

The labelled examples are a documented sample (``EXAMPLES`` per class, by hash), so the index
is bounded and is sent to every task. Terms are 64-bit hashes. Spark counts the postings and
the document frequencies (over the whole corpus) and calibrates; the driver holds the index as
plain arrays of about 14 bytes a posting, never texts or words.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiframe.llm.common import stored
from kpiframe.llm.simhash import fingerprint, linked

#: labelled rows per class that the index holds at most
EXAMPLES = 2048
#: a term that speaks for toxicity weighs its chi-square against the labels if that reaches
#: this (p below 1e-6: about no chance hit among the 50,000 terms of such a sample), else 1
MIN_CHI2 = 24.0
NEIGHBOURS = 16
BLOCK = 32
#: blocks that are scored before the bound is looked at again; then all that can still count
VISIT = 4
#: terms that one example in so many holds are kept as rows over all examples, not as postings
COMMON = 16
#: votes that the base rate has against the neighbours'
PRIOR_VOTES = 0.5
#: texts whose common terms are scored by one matrix product
TOGETHER = 64
#: slots that terms are hashed to when like examples are brought together
SKETCH = 256
#: examples whose votes one task calibrates
CALIBRATED = 128
#: words whose terms, and texts whose neighbours, a task remembers
REMEMBERED, REMEMBERED_TEXTS = 300_000, 10_000

#: ASCII characters that are neither letter nor digit nor apostrophe part words
_PARTS = bytes(i if i > 127 or chr(i).isalnum() or i == 39 else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words as UTF-8; NULL has none."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PARTS).split()


def term(word: bytes) -> int:
    """The 64-bit number that stands for a word."""
    return xxhash.xxh3_64_intdigest(word)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), first[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest scores over 0, ties by number."""
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        at = np.flatnonzero((scores >= least) & (scores > 0))
    else:
        at = np.flatnonzero(scores > 0)
    return at[np.lexsort((at, -scores[at]))][:k]


@dataclass
class Index:
    """Unit vectors of the examples as block-wise postings, and what a score needs.

    Terms are numbered in order of their hashes. A cell is a (term, block) pair that holds
    postings; those of a term stand together, by block, and so do the postings of a cell.
    """

    terms: np.ndarray         # sorted hashes
    idf: np.ndarray
    speaks: np.ndarray        # chi-square of the terms that tell toxic examples, else 1
    of_term: np.ndarray       # first cell of each term, and the end
    block: np.ndarray         # of each cell
    most: np.ndarray          # largest weight in each cell
    first: np.ndarray         # first posting of each cell, and the end
    examples: np.ndarray      # of each posting
    weights: np.ndarray
    row_of: np.ndarray        # of each term its row in ``common``, or -1
    common: np.ndarray        # weights of the common terms in all examples, up to whole blocks
    ids: np.ndarray           # doc_id of each example
    labels: np.ndarray
    base_rate: float
    slope: float = 1.0
    shift: float = 0.0

    def numbers(self, words_: list[bytes]) -> np.ndarray:
        """The term number of each word, -1 for a word that no example has."""
        hashes = np.fromiter(map(term, words_), np.uint64, len(words_))
        at = np.minimum(np.searchsorted(self.terms, hashes), max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == hashes, at, -1) if len(self.terms) else \
            np.full(len(words_), -1)

    def counts(self, text_words: list[bytes], memory: dict[bytes, int]) -> dict[int, int]:
        """{term number: occurrences}; ``memory`` keeps the numbers of words."""
        tf = Counter(text_words)
        new = [w for w in tf if w not in memory]
        if new:
            if len(memory) + len(new) > REMEMBERED:
                memory.clear()
                new = list(tf)
            memory.update(zip(new, self.numbers(new).tolist()))
        return {memory[w]: n for w, n in tf.items() if memory[w] >= 0}

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter(counts, np.int64, len(counts))
        tf = np.fromiter(counts.values(), float, len(counts))
        order = np.argsort(terms)
        terms = terms[order]
        weights = (1 + np.log(tf[order])) * self.idf[terms] * self.speaks[terms]
        norm = math.sqrt(float(weights @ weights))
        return (terms, weights / norm) if norm > 0 else (terms[:0], weights[:0])

    def example(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The vector of an example, from its postings."""
        at = np.flatnonzero(self.examples == number)
        cell = np.searchsorted(self.first, at, "right") - 1
        return np.searchsorted(self.of_term, cell, "right") - 1, self.weights[at]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS,
                without: int = -1) -> list[tuple[float, int]]:
        """The ``k`` most similar examples, ties by number, with similarity over 0."""
        return self.nearest_of_all([(terms, weights)], k, [without])[0]

    def nearest_of_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS,
                       without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """``nearest`` of each vector. What the common terms add is one matrix product for
        ``TOGETHER`` vectors (always of that shape, so that a result does not depend on its
        neighbours); it bounds a block exactly, and the other terms' postings are read for
        the blocks that can still hold one of the best."""
        out: list[list[tuple[float, int]]] = []
        for a in range(0, len(vectors), TOGETHER):
            dense = np.zeros((TOGETHER, len(self.common)))
            rare = []
            for r, (terms, weights) in enumerate(vectors[a:a + TOGETHER]):
                row = self.row_of[terms]
                often = row >= 0
                dense[r, row[often]] = weights[often]
                rare.append((terms[~often], weights[~often]))
            common = dense @ self.common
            top = common.reshape(TOGETHER, -1, BLOCK).max(axis=2)
            for r, (terms, weights) in enumerate(rare):
                out.append(self._near(terms, weights, common[r], top[r], k,
                                      without[a + r] if without else -1))
        return out

    def _near(self, terms: np.ndarray, weights: np.ndarray, common: np.ndarray, top: np.ndarray,
              k: int, without: int) -> list[tuple[float, int]]:
        """The best examples, given the scores by common terms and their maxima by block."""
        first = self.of_term[terms]
        size = self.of_term[terms + 1] - first
        cells, weight = _ranges(first, size), np.repeat(weights, size)
        block = self.block[cells]
        bound = top + np.bincount(block, weight * self.most[cells], len(top))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        wanted = np.zeros(len(top), bool)
        wanted[order[:VISIT]] = True
        scores = self._scores(cells, weight, block, wanted, common, without)
        best = _best(scores, k)
        # a hair of slack: the bound and the score are summed in different orders
        least = scores[best[-1]] if len(best) == k else 0.0
        more = order[VISIT:][bound[order[VISIT:]] * (1 + 1e-6) >= least]
        if len(more):
            wanted[:] = False
            wanted[more] = True
            scores += self._scores(cells, weight, block, wanted, common, without)
            best = _best(scores, k)
        return list(zip(np.minimum(scores[best], 1.0).tolist(), best.tolist()))

    def _scores(self, cells: np.ndarray, weight: np.ndarray, block: np.ndarray, wanted: np.ndarray,
                common: np.ndarray, without: int) -> np.ndarray:
        """Scores of the examples in the wanted blocks, 0 for others and for ``without``."""
        mine = wanted[block]
        first = self.first[cells[mine]]
        size = self.first[cells[mine] + 1] - first
        at = _ranges(first, size)
        scores = np.bincount(self.examples[at], self.weights[at] * np.repeat(weight[mine], size),
                             len(common)) + common
        scores = np.round(scores, 12) * np.repeat(wanted, BLOCK)
        if without >= 0:
            scores[without] = 0
        return scores

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic votes, each the inverse square of its distance, so that a copy
        outvotes texts that share common words; the base rate votes too."""
        total, toxic = PRIOR_VOTES, PRIOR_VOTES * self.base_rate
        for similarity, example in near:
            weight = 1 / (0.1 + max(0.0, 1 - similarity)) ** 2
            total += weight
            toxic += weight * self.labels[example]
        return toxic / total

    def score(self, vote: float) -> float:
        p = min(max(vote, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.slope * math.log(p / (1 - p)) + self.shift)))


def _calibrated(votes: np.ndarray, y: np.ndarray, base_rate: float) -> tuple[float, float]:
    """(slope, shift) of the logistic map from votes to probabilities, fitted on each
    example's vote without itself; classes weigh as often as they occur among the labels."""
    votes = np.clip(votes, 1e-6, 1 - 1e-6)
    x = np.log(votes / (1 - votes))
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, base_rate / n1, (1 - base_rate) / n0) * len(y)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([g @ x + 1e-2 * (a - 1), g.sum()])
        hess = np.array([[h @ (x * x) + 1e-2, h @ x], [h @ x, h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.05), b


def _calibrate(spark: SparkSession, index: Index) -> None:
    """Votes of the examples among the others, in tasks of ``CALIBRATED`` examples."""
    sent = spark.sparkContext.broadcast(vars(index))

    def run(batches):
        model = Index(**sent.value)
        for batch in batches:
            numbers = batch.column("id").to_pylist()
            near = model.nearest_of_all([model.example(i) for i in numbers], without=numbers)
            votes = [model.vote(x) for x in near]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(votes, pa.float64())],
                                             ["id", "vote"])

    n = len(index.ids)
    found = spark.range(0, n, 1, max(1, -(-n // CALIBRATED))).mapInArrow(run, "id long, vote double")
    votes = np.zeros(n)
    for i, vote in found.collect():  # one row per example of the bounded sample
        votes[i] = vote
    sent.destroy()
    index.slope, index.shift = _calibrated(votes, index.labels.astype(float), index.base_rate)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def held_out(doc_id: Column) -> Column:
    """Whether a doc_id's label may not be learned from (NULL: as the empty string)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _distinct(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(id, fp) of one example per label and component of near-equal SimHash fingerprints."""
    fps = np.unique(np.array([fp for _, _, fp in rows], np.int64)).view(np.uint64)
    root = {int(f): int(f) for f in fps}

    def find(f: int) -> int:
        while root[f] != f:
            root[f] = f = root[root[f]]
        return f

    for a, b in linked(fps, None).tolist() if len(fps) else []:
        root[find(a)] = find(b)
    first: dict[tuple[int, int], tuple[int, int]] = {}
    for i, label, fp in sorted(rows):
        first.setdefault((label, find(fp % (1 << 64))), (i, fp))
    return sorted(first.values())


def _spelled(chosen: DataFrame) -> DataFrame:
    """(id, label, fp, term, tf) of the examples; ``fp`` is the text's SimHash."""
    def spell(batches):
        for batch in batches:
            for i, y, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text"))):
                tf = Counter(words(t))
                n = len(tf)
                fp = np.full(n, fingerprint((t or "").encode("utf-8", "replace")), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, i, np.int64)), pa.array(np.full(n, y, np.int32)),
                     pa.array(fp.view(np.int64)),
                     pa.array(np.fromiter(map(term, tf), np.uint64, n).view(np.int64)),
                     pa.array(np.fromiter(tf.values(), np.int64, n))], ["id", "label", "fp", "term", "tf"])

    return chosen.mapInArrow(spell, "id long, label int, fp long, term long, tf long") \
        .groupBy("id", "label", "fp", "term").agg(F.sum("tf").alias("tf"))


def _frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents that hold each of the sorted ``terms``, documents), over the whole corpus. A
    task returns the terms it has met, at most all of the sample's."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(terms)

    def count(batches):
        index = Index(sent.value, *[None] * 12, 0.0)
        memory: dict = {}
        df = np.zeros(len(index.terms), np.int64)
        n_docs = 0
        for batch in batches:
            for text in batch.column("text"):
                found = index.counts(words(text.as_py()), memory)
                df[np.fromiter(found, np.int64, len(found))] += 1
                n_docs += 1
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(met, -1).astype(np.int32)), pa.array(np.append(df[met], n_docs))],
            ["term", "n"])

    counted = _rows(docs).select("text").mapInArrow(count, "term int, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most a row per term
    at, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    df = np.zeros(len(terms), np.int64)
    df[at[at >= 0]] = n[at >= 0]
    sent.destroy()
    return df, int(n[at < 0].sum())


def _clustered(rows: np.ndarray) -> np.ndarray:
    """An order of the rows in which those of a block are alike: halved again and again along
    their principal direction, at a multiple of the block's size."""
    parts, done = [np.arange(len(rows))], []
    while parts:
        at = parts.pop()
        if len(at) <= BLOCK:
            done.append(at)
            continue
        x = rows[at] - rows[at].mean(axis=0)
        axis = x[np.argmax((x ** 2).sum(axis=1))]
        for _ in range(8):
            turned = x.T @ (x @ axis)
            axis = turned / max(float(np.linalg.norm(turned)), 1e-300)
        order = at[np.argsort(x @ axis, kind="stable")]
        half = BLOCK * max(1, round(len(at) / BLOCK / 2))
        parts += [order[half:], order[:half]]
    return np.concatenate(done)


def _speaks(term_: np.ndarray, y: np.ndarray, n_terms: int, n: np.ndarray,
            min_chi2: float) -> np.ndarray:
    """Chi-square of each term's 2 x 2 table with the labels (Yates' correction) if the term
    speaks for toxicity and reaches ``min_chi2``, else 1. ``y`` is the label of each posting,
    ``n`` the labels of the examples."""
    p, q = n.sum(), len(n) - n.sum()
    a = np.bincount(term_, y, n_terms)
    b = np.bincount(term_, 1 - y, n_terms)
    cross = np.maximum(0, np.abs(a * (q - b) - b * (p - a)) - (p + q) / 2)
    chi2 = (p + q) * cross ** 2 / np.maximum(1, (a + b) * (p + q - a - b)) / p / q
    return np.where((chi2 >= min_chi2) & (a * q > b * p), chi2, 1.0)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES,
        min_chi2: float = MIN_CHI2) -> Index | None:
    """The index of a sample of at most ``examples`` labelled rows per class, chosen by the
    hash of doc_id, without the held-out rows; None if a class has no example (then there is
    nothing to learn). Of copies and near copies (SimHash, 4 bits) with one label one is
    used. NULL labels and labels without a document are skipped; a document
    with two labels counts as toxic if one says so."""
    spark = docs.sparkSession
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
                           & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("l_id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("label")))
    known = stored(known, "toxic-labels")
    n1, n = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    order = [F.xxhash64("l_id"), F.col("l_id")]
    sample = known.filter("label = 1").orderBy(*order).limit(examples).unionAll(
        known.filter("label = 0").orderBy(*order).limit(examples))
    # the sample is bounded by 2 * examples short rows; rows that share a doc_id are one example
    chosen = _rows(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")) \
        .select("doc_id", "label", "text")
    tf = stored(_spelled(chosen), "toxic-terms")
    # copies and near copies count once, or a copied text would be all neighbours
    one = _distinct([tuple(r) for r in tf.select("id", "label", "fp").distinct().collect()])
    ids = np.array(sorted({i for i, _ in one}), np.int64)
    label_of = dict(tf.select("id", "label").distinct().collect())
    y = np.array([label_of[i] for i in ids.tolist()])
    if not len(ids) or y.all() or not y.any():
        return None
    number = {i: k for k, i in enumerate(ids.tolist())}
    kept = spark.createDataFrame([(number[i], i, fp) for i, fp in one], "e int, id long, fp long")
    tf = stored(tf.join(F.broadcast(kept), ["id", "fp"]).groupBy("term", "e")
                .agg(F.sum("tf").cast("int").alias("tf")), "toxic-examples")
    terms = np.sort(tf.select("term").distinct().toArrow().column("term").to_numpy().view(np.uint64))
    df, n_docs = _frequencies(docs, terms)
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    # all postings of the sample, as columns
    postings = tf.toArrow()
    term_ = np.searchsorted(terms, postings.column("term").to_numpy().view(np.uint64)).astype(np.int32)
    of = postings.column("e").to_numpy().astype(np.int32)
    speaks = _speaks(term_, y[of], len(terms), y, min_chi2)
    weight = (1 + np.log(postings.column("tf").to_numpy())) * idf[term_] * speaks[term_]
    del postings
    norm = np.sqrt(np.bincount(of, weight ** 2, len(ids)))
    weight = weight / norm[of]
    # like examples stand together: their blocks have sharp bounds
    slot = (terms % np.uint64(SKETCH)).astype(np.int64)
    sign = np.where((terms >> np.uint64(60)) & np.uint64(1), 1.0, -1.0)
    place = _clustered(np.bincount(of * SKETCH + slot[term_], weight * sign[term_],
                                   len(ids) * SKETCH).reshape(-1, SKETCH))
    moved = np.empty(len(ids), np.int64)
    moved[place] = np.arange(len(ids))
    ids, y = ids[place], y[place]
    key = term_.astype(np.int64) * len(ids) + moved[of]
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    term_, of = key // len(ids), (key % len(ids)).astype(np.uint16 if len(ids) < 1 << 16 else np.int32)
    blocks = -(-len(ids) // BLOCK)
    cells, first = np.unique(term_ * blocks + of // BLOCK, return_index=True)
    held = np.bincount(term_, minlength=len(terms))
    often = np.flatnonzero(held * COMMON >= len(ids))
    row_of = np.full(len(terms), -1, np.int32)
    row_of[often] = np.arange(len(often))
    common = np.zeros((len(often), blocks * BLOCK))
    mine = row_of[term_] >= 0
    common[row_of[term_[mine]], of[mine]] = weight[mine]
    index = Index(terms, idf, speaks, np.searchsorted(cells, np.arange(len(terms) + 1) * blocks),
                  (cells % blocks).astype(np.int32), np.maximum.reduceat(weight, first),
                  np.append(first, len(weight)), of, weight, row_of, common, ids, y, n1 / n)
    _calibrate(spark, index)
    return index


def _sent(docs: DataFrame, model: Index | None) -> Broadcast:
    """The index as a broadcast of plain values: pickled once, and without this module."""
    return docs.sparkSession.sparkContext.broadcast(model and vars(model))


def _received(values: dict | None) -> Index | None:
    return None if values is None else Index(**values)


def score_texts(index: Index | None, texts: list[str | None],
                memory: tuple[dict, dict]) -> list[tuple[float, list]]:
    """(score, neighbours) of each text; without an index scores are 0. ``memory`` keeps the
    terms of words and the results of vectors: copies are searched once."""
    if index is None:
        return [(0.0, [])] * len(texts)
    words_, results = memory
    if len(results) + len(texts) > REMEMBERED_TEXTS:
        results.clear()
    new, keys = {}, []
    for text in texts:
        vector = index.vector(index.counts(words(text), words_))
        keys.append(xxhash.xxh3_128_digest(vector[0].tobytes() + vector[1].tobytes()))
        if keys[-1] not in results:
            new[keys[-1]] = vector
    for key, near in zip(new, index.nearest_of_all(list(new.values()))):
        results[key] = index.score(index.vote(near)), near
    return [results[key] for key in keys]


def _scored(index: Index | None, column: pa.Array, memory: tuple[dict, dict]) -> list:
    """``score_texts`` of an Arrow column, some texts at a time."""
    out: list = []
    for a in range(0, len(column), 8 * TOGETHER):
        out += score_texts(index, column.slice(a, 8 * TOGETHER).to_pylist(), memory)
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5) and
    neighbours: the evidence, an array of (doc_id, similarity, label), nearest first.

    A text without any term of the examples (NULL and empty ones too) has no neighbours and
    gets the calibrated base rate. If the labels hold one class only, every score is 0.
    """
    sent = _sent(docs, fit(docs, labels, **options))  # bounded
    kind = ("doc_id long, score double, "
            "neighbours array<struct<doc_id: long, similarity: double, label: int>>")

    def run(batches):
        memory: tuple[dict, dict] = ({}, {})
        model = _received(sent.value)
        fields = [pa.field("doc_id", pa.int64()), pa.field("similarity", pa.float64()),
                  pa.field("label", pa.int32())]
        for batch in batches:
            out = _scored(model, batch.column("text"), memory)
            flat = [n for _, near in out for n in near]
            ends = np.concatenate([[0], np.cumsum([len(near) for _, near in out])]).astype(np.int32)
            at = np.array([e for _, e in flat], np.int64)
            near = pa.StructArray.from_arrays(
                [pa.array(model.ids[at] if len(at) else at, pa.int64()),
                 pa.array([s for s, _ in flat], pa.float64()),
                 pa.array(model.labels[at] if len(at) else at, pa.int64()).cast(pa.int32())],
                fields=fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()),
                 pa.ListArray.from_arrays(pa.array(ends), near)], ["doc_id", "score", "neighbours"])

    return _rows(docs).mapInArrow(run, kind).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; all columns stay as they are.
    NULL and empty texts get the base rate and stay, if under half of the labels are toxic;
    repeated rows are judged alike."""
    sent = _sent(docs, fit(docs, labels, **options))  # bounded

    def run(batches):
        memory: tuple[dict, dict] = ({}, {})
        model = _received(sent.value)
        for batch in batches:
            keep = [score < 0.5 for score, _ in _scored(model, batch.column("text"), memory)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
