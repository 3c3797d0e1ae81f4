"""Training-data operators and their registered queries (``op1_`` to ``op13_``, ``pipeline``)."""
