"""The corpus pipeline, stage by stage."""

import __spark_entry__ as E
import corpus_pipeline as P
from kpiframe.llm import decontaminate, line_dedup, simhash, toxicity
from tests.conftest import SF_SMALL


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup",
                                        "benchmark decontamination", "mixing sources to target weights"]
    assert E.queries()["pipeline"] is P.run
    assert {k.split("_")[0] for k in E.queries() if k.startswith("op")} >= {f"op{i}" for i in range(1, 14)}


def test_each_stage_decides_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    benchmark = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    stages = dict(P.STAGES)
    columns = docs.columns

    def after(name, df):
        out = stages[name](spark, df, SF_SMALL)
        return spark.createDataFrame(out.collect(), out.schema)

    kept = after("toxicity", docs)
    want = {r.doc_id for r in toxicity.score_toxicity(docs, labels).filter("predicted = 0").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want

    lines = after("line dedup", kept)
    dropped = {r.doc_id: r.n_dropped for r in line_dedup.line_report(kept).collect()}
    before = {r.doc_id: r.text for r in kept.collect()}
    assert lines.columns == columns
    for r in lines.collect():
        assert (r.text == before[r.doc_id]) == (dropped[r.doc_id] == 0)
        assert r.n_chars == len(r.text) or dropped[r.doc_id] == 0

    near = after("SimHash near-dedup", lines)
    roots = {r.component_id for r in simhash.near_duplicates(lines).collect()}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == roots

    clean = after("benchmark decontamination", near)
    leaks = {r.doc_id for r in decontaminate.contaminated(near, benchmark).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == roots - leaks

    mixed = after("mixing sources to target weights", clean)
    assert mixed.columns == columns + ["copy", "words", "position"]
    assert {r.doc_id for r in mixed.collect()} <= roots - leaks


def in_turn(spark, sf_dir):
    """The stages one after the other, each result fetched and made a table anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(out.collect(), out.schema)
    return docs


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_run_equals_the_stages(spark):
    out = P.run(spark, SF_SMALL)
    assert out.columns[-3:] == ["copy", "words", "position"]
    rows = rows_of(out)
    assert rows and rows == rows_of(in_turn(spark, SF_SMALL))
    # written in training order
    path = out.inputFiles()[0].rsplit("/", 1)[0]
    read = [r.position for f in sorted(out.inputFiles()) for r in spark.read.parquet(f).collect()]
    assert path and read == sorted(read)


def corpus(spark, folder, docs):
    """Source tables with these documents and the labels and benchmark of the test data."""
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")


def test_awkward_rows_through_the_pipeline(spark, make, awkward, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "source")
    more = [(None if i is None else 10_000_000 + i, t, s) for i, t, s in awkward]
    both = make([tuple(r) for r in docs.collect()] + more)
    corpus(spark, str(tmp_path), both)
    out = P.run(spark, str(tmp_path))
    assert out.columns[:len(both.columns)] == both.columns          # clashing names stay
    rows = rows_of(out)
    assert rows == rows_of(in_turn(spark, str(tmp_path)))
    ids = {r[0] for r in rows}
    # of the copies (4, 5, near 6) one stays, of NULL, empty and blank texts as well
    assert len(ids & {10_000_004, 10_000_005, 10_000_006}) <= 1
    assert 10_000_007 in ids and 10_000_013 in ids


def test_empty_documents_through_the_pipeline(spark, make, tmp_path):
    corpus(spark, str(tmp_path), make([], 1))
    assert P.run(spark, str(tmp_path)).collect() == []
