"""Training-data pipeline operators (dedup, search, filtering, formatting, mixing, packing).

Nothing else in the library imports this subpackage.  Each module holds one operator with
its own general interface; ``queries`` holds the thin registered ``opN_<name>`` queries.
"""
