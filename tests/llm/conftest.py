import random

import pytest

#: names that the operators use inside
CLASHING = ["row", "th", "h", "pos", "size", "target", "copy", "words", "position", "keep", "n",
            "text_", "found", "spans", "fp", "label", "key", "src", "r_id", "doc_id_"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"`{c}` string" for c in CLASHING)


def prose(rng, n, start=0):
    syllables = ["ka", "lo", "mi", "ten", "sur", "vel", "or", "ba", "nin", "du", "pre", "ost"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text, source) rows, with clashing extra columns."""
    def build(rows, partitions=3):
        data = [(i, t, "en", s, None if t is None else len(t), *[f"{c}{i}" for c in CLASHING])
                for i, t, s in rows]
        return spark.createDataFrame(data, SCHEMA).repartition(partitions)
    return build


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and long texts, ties, repeated rows, copies, near copies and passages."""
    rng = random.Random(5)
    passage = prose(rng, 120)
    base = prose(rng, 300)
    words = base.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n \x0b\x0c\r ", None), (4, base, "b"),
            (5, base, "b"), (6, near, None), (7, prose(rng, 90) + "\n" + passage, "a"),
            (8, passage + " " + prose(rng, 80), "c"), (9, "one two", "a"), (9, "one two", "a"),
            (9, "another text for the same id", "c"), (None, "no id here", "a"),
            (None, base, "c"), (10, "É é İ ß 漢字 word " * 30, "b"), (11, "x" * 3000, "a"),
            (12, "ab " * 700, "c"), (-5, prose(rng, 40), "d"), (13, prose(rng, 20000), "a"),
            (14, "tail\n\n\nline\n", "b"), (15, "nul \x00 byte", "b")]
    return rows


def both(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
