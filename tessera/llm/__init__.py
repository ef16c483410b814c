"""Training-data operators: packing, joins on shingles, decontamination, filters, language models, licences.

Each module holds one operator with its own interface; ``queries`` binds them to the given tables.
Nothing outside this package imports it.
"""
