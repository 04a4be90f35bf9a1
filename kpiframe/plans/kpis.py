"""Named KPI queries: compositions of the operators over the report views.

All functions are lazy ``DataFrame → DataFrame``; none collects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.functions.arithmetic import complement, percent_of, row_sum
from kpiframe.functions.nulls import count_if, if_else, sum_na
from kpiframe.functions.text import classify, lookup_by_pattern, percent_label, recode
from kpiframe.functions.util import as_list
from kpiframe.operators.aggregates import group_agg, ratio_of_sums, with_total
from kpiframe.operators.joins import bucketed_pair
from kpiframe.operators.predicates import matches, not_null, range_censor
from kpiframe.operators.reshape import to_long
from kpiframe.operators.schema import cols_matching, select_matching

# ---------------------------------------------------------------- training

# Output column names.
TRAINING_MEASURES = ["male_chws_trained", "female_chws_trained",
                     "male_chws_equipped", "female_chws_equipped"]

# Legend names of the gender series.
GENDER_LABELS = {
    "female_chws_trained": "Female CHWs",
    "male_chws_trained": "Male CHWs",
    "female_chws_equipped": "Female CHWs",
    "male_chws_equipped": "Male CHWs",
    "pct_female_equipped": "Female CHWs",
    "pct_male_equipped": "Male CHWs",
}


def training_base(training: DataFrame, male: str = "male_trained",
                  female: str = "female_trained", handover: str = "equipped_yes_no") -> DataFrame:
    """Trained and equipped CHWs by province × district (missing → 0 in sums;
    a missing hand-over answer leaves the equipped count missing)."""
    yes = F.col(handover) == F.lit("Yes")
    base = not_null(training, "province").withColumns({
        "male_equipped": if_else(yes, F.col(male), 0.0),
        "female_equipped": if_else(yes, F.col(female), 0.0),
    })
    return group_agg(base, ["province", "district"], {
        "male_chws_trained": sum_na(male),
        "female_chws_trained": sum_na(female),
        "male_chws_equipped": sum_na("male_equipped"),
        "female_chws_equipped": sum_na("female_equipped"),
    })


def training_long(base: DataFrame, stat_pattern: str) -> DataFrame:
    """Long form of the training measures whose name matches ``stat_pattern``."""
    long = to_long(base, ["province", "district"], TRAINING_MEASURES, "stat", "count",
                   name_pattern=stat_pattern)
    return matches(long, "stat", stat_pattern)


def trained_by_gender(base: DataFrame, what: str = "trained") -> DataFrame:
    """Trained (or equipped) CHWs by district and gender, with legend names."""
    return training_long(base, what).withColumn("label", recode("stat", GENDER_LABELS))


def target_reached(base: DataFrame, targets, national_target: float,
                   national_label: str = "National") -> DataFrame:
    """Trained CHWs per district against targets found by name pattern (first
    match wins), plus one national row against the national target."""
    long = training_long(base, "trained")
    # the flag, not the label, says which row is national: a district may be called so
    g = with_total(long, ["district"], {"chws_trained": sum_na("count")},
                   label=national_label, flag="_national")
    g = g.withColumn("target_chws",
                     F.when(F.col("_national"), F.lit(float(national_target)))
                     .otherwise(lookup_by_pattern("district", targets))).drop("_national")
    g = g.withColumn("pct_trained", percent_of("chws_trained", "target_chws", 0))
    return g.withColumns({
        "pct_label": percent_label("pct_trained"),
        "label_y": F.col("chws_trained") + F.lit(100.0),
    })


def pct_equipped(base: DataFrame) -> DataFrame:
    """% of trained CHWs who are equipped, by gender (2 decimals)."""
    wide = base.withColumns({
        "pct_male_equipped": percent_of("male_chws_equipped", "male_chws_trained", 2),
        "pct_female_equipped": percent_of("female_chws_equipped", "female_chws_trained", 2),
    })
    long = to_long(wide, ["province", "district"], ["pct_male_equipped", "pct_female_equipped"],
                   "stat", "count")
    return long.withColumn("label", recode("stat", GENDER_LABELS))


# ---------------------------------------------------------------- facility report

# How a count column's name is read (age group, gender, disease).
AGE_RULE = "5"
GENDER_RULES = [("_female", "Female"), ("_male", "Male")]
DISEASE_RULES = [("malaria", "Malaria"), ("pneumonia", "Pneumonia"), ("diarrhoea", "Diarrhoea")]
REPORT_IDS = ["district", "facility", "period", "periodname"]


def classify_stat(df: DataFrame, stat: str) -> DataFrame:
    """Age group, gender and disease read from a count column's name."""
    return df.withColumns({
        "age_group": F.when(F.coalesce(F.col(stat).rlike(AGE_RULE), F.lit(False)),
                            F.lit("Under 5")).otherwise(F.lit("All Ages")),
        "gender": classify(stat, GENDER_RULES, default="Combined"),
        "disease": classify(stat, DISEASE_RULES),
    })


REFERRAL_KEYS = REPORT_IDS + ["age_group", "gender", "disease"]


def managed_long(report: DataFrame, managed_cols) -> DataFrame:
    """Managed case counts in long form: the given columns, then those whose
    name contains "5" (under-five), missing counts dropped."""
    sel = report.select(*REPORT_IDS, *as_list(managed_cols))
    long = to_long(sel, REPORT_IDS, cols_matching(sel, "5"), "stat2", "managed_count",
                   drop_na=True)
    return classify_stat(long, "stat2")


def referred_long(report: DataFrame) -> DataFrame:
    """Referral counts in long form: every column whose name contains "referred"."""
    sel = select_matching(report, REPORT_IDS, "referred")
    long = to_long(sel, REPORT_IDS, cols_matching(sel, "referred"), "stat", "referral_count",
                   drop_na=True)
    return classify_stat(long, "stat")


def _cell(side: str, name: str):
    # labels depend only on the column name: built over a literal, Catalyst
    # folds them at plan time, so no regex runs per row
    lit = F.lit(name)
    return F.struct(F.lit(side).alias("side"), lit.alias("stat"),
                    F.col(name).cast("double").alias("n"),
                    F.when(F.coalesce(lit.rlike(AGE_RULE), F.lit(False)), F.lit("Under 5"))
                    .otherwise(F.lit("All Ages")).alias("age_group"),
                    classify(lit, GENDER_RULES, default="Combined").alias("gender"),
                    classify(lit, DISEASE_RULES).alias("disease"))


def count_cells(report: DataFrame, managed_cols) -> DataFrame:
    """Every present managed / referred count cell as a row tagged with its
    side (``M`` / ``R``) and classified by its column name.

    One row-local generator over one projection of the report, so both sides
    of the referral pairing come from a single scan.
    """
    referred_cols = cols_matching(report, "referred")
    managed = cols_matching(report.select(*REPORT_IDS, *as_list(managed_cols)), "5")
    cells = [_cell("M", c) for c in managed] + [_cell("R", c) for c in referred_cols]
    return report.select(*REPORT_IDS, F.inline(F.array(*cells))).filter(F.col("n").isNotNull())


def referral_joined(report: DataFrame, managed_cols) -> DataFrame:
    """Referral rows with their managed counts (NULL when there is none):
    referred ⟕ managed on the seven keys, NULL matching NULL.

    The cells of both sides are written once, bucketed and sorted by the keys
    (``operators.joins.bucketed_pair``), so the join itself has no exchange and the report
    is computed once. Writing is a job that runs when this function is called.
    """
    refs, mans, key = bucketed_pair(count_cells(report, managed_cols), REFERRAL_KEYS,
                                    "side", "R", "M")
    refs = refs.withColumnsRenamed({"n": "referral_count"})
    mans = mans.select(F.col(key).alias("_m"), F.col("stat").alias("stat2"),
                       F.col("n").alias("managed_count"))
    return refs.join(mans, F.col(key) == F.col("_m"), "left").select(
        *REFERRAL_KEYS, "stat", "referral_count", "stat2", "managed_count")


def referral(report: DataFrame, managed_cols, digits: int = 2) -> DataFrame:
    """Proportion of managed under-5 cases that were referred, by district,
    month, gender and disease; proportions above 1 are kept as NULL.

    Same result as "referred ⟕ managed on the seven keys (NULL matches NULL),
    keep matched rows, sum both counts" — including the fan-out when a key
    repeats — but planned without a join. Both sides come from the same
    report rows, so every count cell becomes one row tagged with its side
    (a row-local generator, one scan) and is aggregated once on the seven
    keys. For a key with referral counts R and managed counts M the join
    yields |R|·|M| rows, whose sums are sum(R)·|M| and sum(M)·|R|; keys with
    no managed row are the unmatched ones. Both aggregations are partial +
    final, so a hot key is folded map-side.
    """
    long = count_cells(report, managed_cols)
    is_r, is_m = F.col("side") == F.lit("R"), F.col("side") == F.lit("M")
    per_key = group_agg(long, REFERRAL_KEYS, {
        "sum_r": F.sum(F.when(is_r, F.col("n"))), "cnt_r": count_if(is_r),
        "sum_m": F.sum(F.when(is_m, F.col("n"))), "cnt_m": count_if(is_m),
    })
    matched = per_key.filter((F.col("cnt_r") > 0) & (F.col("cnt_m") > 0)).select(
        "district", "period", "gender", "disease",
        (F.col("sum_r") * F.col("cnt_m")).alias("referral_count"),
        (F.col("sum_m") * F.col("cnt_r")).alias("managed_count"))
    out = ratio_of_sums(matched, ["district", "period", "gender", "disease"],
                        "referral_count", "managed_count", "prop_referred", digits)
    return range_censor(out, "prop_referred", 0.0, 1.0)


def stockout_combined(report: DataFrame, stock_cols, threshold: float = 1.0) -> DataFrame:
    """% of facilities not out of stock, where stock is the sum of several
    pack sizes (missing counts as 0)."""
    filled = report.fillna(0)
    total = row_sum(*as_list(stock_cols))
    g = group_agg(filled, ["district", "period"], {
        "n_facilities": F.count(F.lit(1)),
        "n_stockouts": count_if(total < F.lit(threshold)),
    })
    pct = percent_of("n_stockouts", "n_facilities", 2)
    g = g.withColumns({"percent_stocked_out": pct,
                       "percent_not_stocked_out": complement(pct)})
    return range_censor(g, "percent_not_stocked_out", 0.0, 100.0)


def stockout_by_item(report: DataFrame, items: dict, threshold: float = 1.0) -> DataFrame:
    """% of facilities not out of stock, per item ``{item name: stock column}``,
    in long form with the item named by value (not by position)."""
    filled = report.fillna(0)
    aggs = {"n_facilities": F.count(F.lit(1))}
    for item, col in items.items():
        aggs[f"n_{item}_stockouts"] = count_if(F.col(col) < F.lit(threshold))
    g = group_agg(filled, ["district", "period"], aggs)
    derived = {}
    for item in items:
        pct = percent_of(f"n_{item}_stockouts", "n_facilities", 2)
        derived[f"percent_{item}_stocked_out"] = pct
        derived[f"percent_{item}_not_stocked_out"] = complement(pct)
    g = g.withColumns(derived)
    long = to_long(g, ["district", "period", "n_facilities"],
                   [f"percent_{i}_not_stocked_out" for i in items], "stat", "pct")
    long = long.withColumn("item", recode("stat", {f"percent_{i}_not_stocked_out": i
                                                   for i in items}, keep_unmapped=False))
    return range_censor(long, "pct", 0.0, 100.0)


def case_counts(report: DataFrame, count_cols) -> DataFrame:
    """Case counts by district, month and stage (sum over facilities)."""
    sel = report.select("district", "facility", "period", *as_list(count_cols))
    long = to_long(sel, ["district", "facility", "period"], None, "stat", "count")
    return group_agg(long, ["district", "period", "stat"], {"count": sum_na("count")})


def completeness(report: DataFrame, actual: str = "actual_reports",
                 expected: str = "expected_reports") -> DataFrame:
    """Reports received over reports expected, by district and month."""
    return ratio_of_sums(report, ["district", "period"], actual, expected, "completeness", 2,
                         num_name="actual", den_name="expected")
