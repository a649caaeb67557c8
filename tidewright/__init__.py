"""A Spark-native time-series forecasting and feature engine.

Relational steps are DataFrame expressions that Catalyst plans; grouped pandas
functions appear only where a value depends on the previous step's result.
"""

__version__ = "0.1.0"
