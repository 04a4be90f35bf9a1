"""Schema operators: name normalisation and projections.

Column lists are resolved on the driver from ``df.columns`` (metadata only,
no job); the projection itself is a plain ``select`` that Catalyst prunes
down to the Parquet scan.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.functions.util import as_list

# Symbol spellings used when normalising names.
NAME_SYMBOL_WORDS = {"%": "percent", "#": "number"}


def _ascii(name: str) -> str:
    """Accented letters to their base letter ("Número" → "Numero")."""
    decomposed = unicodedata.normalize("NFKD", name)
    return "".join(ch for ch in decomposed if not unicodedata.combining(ch))


def _snake(name: str) -> str:
    s = _ascii(name)
    for sym, word in NAME_SYMBOL_WORDS.items():
        s = s.replace(sym, f"_{word}_")
    s = s.replace("'", "").replace('"', "")
    # split camel case: "maleCount" -> "male_Count", "CHWs" -> "CH_Ws"
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_name_list(names: list[str]) -> list[str]:
    """Unique snake_case names; repeats get ``_2``, ``_3`` ... in order."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for n in names:
        base = _snake(n)
        k = seen.get(base, 0) + 1
        seen[base] = k
        cand = base if k == 1 else f"{base}_{k}"
        while cand in out:
            k += 1
            seen[base] = k
            cand = f"{base}_{k}"
        out.append(cand)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """Normalise every column name to unique snake_case (``RHCC Target (clinical)``
    → ``rhcc_target_clinical``, ``rhcc1.1`` → ``rhcc1_1``, ``CHWs`` → ``ch_ws``)."""
    return df.toDF(*clean_name_list(df.columns))


def tag(df: DataFrame, name: str, value) -> DataFrame:
    """Add (or overwrite) a constant column, e.g. the source a table came from."""
    return df.withColumn(name, F.lit(value))


def cols_matching(df: DataFrame, substring: str, case_sensitive: bool = False) -> list[str]:
    """Names containing ``substring`` (``contains("referred")``)."""
    if case_sensitive:
        return [c for c in df.columns if substring in c]
    s = substring.lower()
    return [c for c in df.columns if s in c.lower()]


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` inclusive, in table order (``a:b``)."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    if i > j:
        i, j = j, i
    return cols[i:j + 1]


def cols_except(df: DataFrame, exclude) -> list[str]:
    """All names but ``exclude`` (``-c(a, b)``)."""
    ex = set(as_list(exclude))
    return [c for c in df.columns if c not in ex]


def select_matching(df: DataFrame, keep, substring: str) -> DataFrame:
    """``select(keep..., contains(substring))``."""
    keep = as_list(keep)
    return df.select(*keep, *[c for c in cols_matching(df, substring) if c not in keep])


def select_range(df: DataFrame, keep, first: str, last: str) -> DataFrame:
    keep = as_list(keep)
    return df.select(*keep, *[c for c in cols_between(df, first, last) if c not in keep])


def select_except(df: DataFrame, exclude) -> DataFrame:
    return df.select(*cols_except(df, exclude))


def rename_select(df: DataFrame, columns, renames: dict | None = None) -> DataFrame:
    """Select a list of columns, renaming some of them (``{"old": "new"}``)."""
    renames = renames or {}
    return df.select(*[F.col(c).alias(renames.get(c, c)) for c in as_list(columns)])


def with_columns(df: DataFrame, exprs: dict) -> DataFrame:
    """Several derived columns in one projection (later ones may not see earlier ones)."""
    return df.withColumns(exprs)
