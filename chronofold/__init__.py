"""chronofold: deterministic event projection on Spark.

An ordered event log is routed, upcast, projected and folded per entity into rows,
documents, key-value pairs and a property graph; every event yields an outcome row.
"""
