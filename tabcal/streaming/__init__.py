"""No streaming operators: the batch jobs this library covers hold no stream state.

Everything in ``tabcal.functions`` and the row-level recodes in
``tabcal.operators.recode`` are stateless column expressions, so they also run
unchanged on a streaming DataFrame (``tests/test_streaming.py``).
"""
