"""Training-data operators: decontamination, quality, licences, near copies, language-model scores,
conversations, sharding, toxicity, packing and host rules.

Nothing else in the library imports this package; `queries.py` registers one query per operator.
"""
