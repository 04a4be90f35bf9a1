"""kpiframe — programme-monitoring KPI operators on Spark.

Layers: ``functions`` (Column → Column), ``operators`` (DataFrame →
DataFrame), ``sources`` (readers, writers, generators), ``plans`` (views,
KPI queries, catalog) and ``streaming`` (incremental refresh).
"""

__version__ = "0.1.0"
