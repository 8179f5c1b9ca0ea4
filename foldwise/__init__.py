"""foldwise: leak-aware tabular feature, fold and scoring operators on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL /
DataFrame expressions (and MLlib estimators at the model boundary).  Fitted
statistics are small DataFrames joined back to the rows; nothing row-sized is
collected to the driver.
"""

__version__ = "0.1.0"
