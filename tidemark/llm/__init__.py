"""Training-data operators: joins, classifiers, tokens, packing, stores, scans.

Nothing outside this package imports it; ``catalog`` registers its queries.
"""
