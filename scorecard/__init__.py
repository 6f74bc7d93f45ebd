"""scorecard: rubric evaluation of large text collections on Spark.

Every operator is a lazy ``f(DataFrame, ...) -> DataFrame`` built from
Spark SQL expressions; nothing inside the library collects data to the
driver.  Long, normalized tables (one row per question / dimension /
concept / model / text score) are the source of truth; nested documents
exist only at the import/export edge.
"""

__version__ = "0.1.0"
