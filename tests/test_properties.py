"""Randomised checks of the two plans that replace a literal formulation:
the join-free referral pairing and the chunked (skew-safe) row numbering."""

import datetime as dt

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from kpiframe import operators as O
from kpiframe.plans import kpis as K

MANAGED = ["diarrhoea_5_female", "malaria_treated_5yrs"]
SCHEMA = ("district string, facility string, period date, periodname string, "
          "diarrhoea_5_female double, malaria_treated_5yrs double, "
          "diarrhoea_referred_5_female double, malaria_referred_5yrs double")

count = st.one_of(st.none(), st.integers(0, 9).map(float))
report_row = st.tuples(st.sampled_from(["D1", "D2", None]), st.sampled_from(["F1", "F2"]),
                       st.sampled_from([dt.date(2025, 7, 1), dt.date(2025, 8, 1)]),
                       st.just("P"), count, count, count, count)
SETTINGS = settings(max_examples=12, deadline=None, derandomize=True,
                    phases=[Phase.explicit, Phase.reuse, Phase.generate],
                    suppress_health_check=[HealthCheck.function_scoped_fixture,
                                           HealthCheck.too_slow])
IDS = ["district", "facility", "period", "periodname"]


def _labels(name):
    gender = "Female" if "_female" in name else ("Male" if "_male" in name else "Combined")
    disease = ("Malaria" if "malaria" in name else "Pneumonia" if "pneumonia" in name
               else "Diarrhoea" if "diarrhoea" in name else None)
    return ("Under 5" if "5" in name else "All Ages"), gender, disease


def _join_then_sum(rows):
    """The literal formulation, row by row in Python: long form of both sides,
    missing counts dropped, inner pairing on the seven keys (None == None),
    then sums per (district, period, gender, disease)."""
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    ref, man = [], []
    for r in rows:
        rec = dict(zip(cols, r))
        for c in cols[4:]:
            if rec[c] is None:
                continue
            key = tuple(rec[k] for k in IDS) + _labels(c)
            (ref if "referred" in c else man).append((key, rec[c]))
    sums = {}
    for rk, rv in ref:
        for mk, mv in man:
            if rk == mk:
                g = (rk[0], rk[2], rk[5], rk[6])
                a, b = sums.get(g, (0.0, 0.0))
                sums[g] = (a + rv, b + mv)
    return sums


@SETTINGS
@given(rows=st.lists(report_row, min_size=1, max_size=12))
def test_referral_matches_brute_force_join(spark, rows):
    """Repeated keys (fan-out), NULL keys and missing counts included."""
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.district, r.period, r.gender, r.disease): (r.referral_count, r.managed_count)
           for r in K.referral(df, MANAGED).collect()}
    assert got == _join_then_sum(rows)


@SETTINGS
@given(groups=st.lists(st.tuples(st.sampled_from(["hot", "a", "b", None]),
                                 st.integers(-50, 50)), min_size=1, max_size=60, unique=True),
       chunks=st.integers(2, 9))
def test_chunked_numbering_matches_window(spark, groups, chunks):
    df = spark.createDataFrame(groups, "g string, t long")
    plain = O.number_within(df, "g", "t", "rn")
    chunked = O.number_within(df, "g", "t", "rn", chunks=chunks)
    assert sorted(map(tuple, chunked.collect()), key=str) == \
        sorted(map(tuple, plain.collect()), key=str)
