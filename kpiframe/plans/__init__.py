"""Query plans: views over the driver tables, KPI compositions, the catalog."""
