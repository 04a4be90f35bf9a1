"""Ingest of per-district facility report files into one facility × month table.

The dashboards read one CSV export per district, normalise the headers,
tag each file with its district, append them, derive the month, rename the
organisation unit to ``facility`` and drop rows that are aggregate levels
(ministry, province, district) rather than facilities. Here the files are
read as one scan over a glob (no per-file loop on the driver), and the
district comes from the folder each file sits in, or from the file's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kpiframe.functions.dates import period_parse
from kpiframe.operators.predicates import exclude_values
from kpiframe.operators.schema import clean_names
from kpiframe.sources.files import read_many

# folder layout "<root>/<key>=<district>/<file>.csv" or "<root>/<district>/<file>.csv"
DISTRICT_FROM_FOLDER = r"/(?:[^/=]+=)?([^/]+)/[^/]+$"
# file layout "<root>/<district>_<anything>.csv" or "<root>/<district>.csv"
DISTRICT_FROM_FILE = r"/([^/_.]+)[^/]*$"
# What the header row calls the unit and the month, after normalisation
UNIT_COLUMNS = ("organisation_unit_name", "organisationunitname")
MONTH_COLUMNS = ("period_name", "periodname")
# the folder that a partitioned write makes for a missing value
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def path_part(path, rx: str):
    """A decoded part of a file's URL (blanks are ``%20`` there); NULL for a missing
    partition value or no match."""
    # the URL form escapes % and leaves + alone, which url_decode would read as a blank
    part = F.regexp_extract(path, rx, 1)
    part = F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))
    return F.when(~part.isin("", NO_VALUE), part)


def _first_of(names, columns: list[str], what: str) -> str:
    for name in [names] if isinstance(names, str) else names:
        if name in columns:
            return name
    raise ValueError(f"no {what} column: looked for {names} in {columns}")


def facility_reports(spark: SparkSession, pattern: str, schema: StructType | str,
                     exclude=(), unit_col=UNIT_COLUMNS, month_col=MONTH_COLUMNS,
                     district_from: str = "folder",
                     district_rx: str | None = None) -> DataFrame:
    """Read every file matching ``pattern`` (raw display headers in ``schema``)
    and return ``district, facility, period, periodname, <measures...>``.

    The district is the ``district_from`` part of the path: the ``"folder"`` of the
    file, or the start of the ``"file"`` name up to ``_`` or ``.`` (or what
    ``district_rx`` captures). ``unit_col`` and ``month_col`` are normalised header
    names, or several to look for. ``exclude`` lists organisation units that are not
    facilities; a missing unit name is dropped as well.
    """
    if district_rx is None:
        district_rx = {"folder": DISTRICT_FROM_FOLDER, "file": DISTRICT_FROM_FILE}[district_from]
    raw = read_many(spark, pattern, schema, source_col="source_file")
    names = schema.fieldNames() if isinstance(schema, StructType) else \
        spark.createDataFrame([], schema).columns
    raw = raw.select(*[F.col(f"`{n}`") for n in names], "source_file")
    df = clean_names(raw)
    unit_col = _first_of(unit_col, df.columns, "unit")
    month_col = _first_of(month_col, df.columns, "month")
    district = path_part(F.col("source_file"), district_rx)
    df = df.withColumns({"district": district, "period": period_parse(month_col)})
    df = df.withColumnRenamed(unit_col, "facility").withColumnRenamed(month_col, "periodname")
    df = exclude_values(df, "facility", list(exclude))
    measures = [c for c in df.columns if c not in ("district", "facility", "period",
                                                   "periodname", "source_file")]
    return df.select("district", "facility", "period", "periodname", *measures)
