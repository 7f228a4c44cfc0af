"""Training-data operators on Spark.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""
