"""lakegauge: data-quality measurement on Spark.

Profiles tables, tests declarative rules, folds the measurements into six
quality dimensions (0-10), scores and classes, and answers the usual questions
about a history of such runs. Every operator is a function from DataFrame (or
Column) to DataFrame (or Column) and stays lazy until the caller acts.
"""
