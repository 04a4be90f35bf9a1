"""Parameters of the KPI definitions run on the star-schema tables (shared by
the query catalog and the dashboard refresh job)."""

# District targets by name pattern; first match wins, so NATION_1 gets 70
# although it also matches 'NATION_1'.
DISTRICT_TARGETS = [("NATION_1$", 70.0), ("NATION_1", 60.0), ("NATION_2", 40.0)]
NATIONAL_TARGET = 1000.0
NATIONAL_LABEL = "National"
STOCK_ITEMS = {"a": "stock_a", "n": "stock_n", "r": "stock_r"}
PRIORITY_LEVELS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
HIST_BINS = 50
