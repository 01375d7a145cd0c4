"""Operations of a large training-data pipeline, as Spark jobs.

Thirteen operators, one module each; ``queries.py`` holds the thin queries over the
shared tables.  Nothing else in the library imports this subpackage.
"""
