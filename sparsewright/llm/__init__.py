"""Training-data operators: ten corpus-preparation steps for very large text tables.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; ``queries`` holds the thin benchmark queries and their SQL.
"""
