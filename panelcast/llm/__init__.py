"""Training-data operators: one module per operator, queries in `queries`.

Nothing else in the library imports this package; `corpus_pipeline.py` at the
repository top chains five of the operators.
"""
