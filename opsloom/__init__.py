"""opsloom: analysis of operations data (logs, documents, graphs, metrics) on Spark.

Every public function takes and returns DataFrames or Columns; nothing is
collected on the driver unless its size is bounded by an argument.
"""
