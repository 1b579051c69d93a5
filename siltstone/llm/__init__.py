"""Training-data operators: ten self-contained modules and the queries that apply them.

Nothing outside this subpackage imports it; removing the folder leaves the rest of the engine whole.
"""
