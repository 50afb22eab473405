"""Pure Python kernels: no Spark, one object at a time."""
