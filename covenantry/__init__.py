"""Covenantry: a PySpark-native analytics engine for collections of contracts and other long documents."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
