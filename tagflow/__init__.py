"""tagflow: Spark-native analytics for short tagged texts.

Every operator is a function ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions``; Catalyst plans the work, AQE re-plans joins and
skew at run time.  See README.md for the layout.
"""

__version__ = "0.1.0"
