"""Training-data operators: scoring, de-duplication, tokenisation, archives.

Each module holds one operator with a general DataFrame interface; ``registry``
holds the registered queries, which read the driver tables and derive the
digest columns from the operators' outputs.  Nothing outside this package
imports it.
"""
