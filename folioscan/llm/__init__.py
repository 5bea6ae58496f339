"""Training-data operators: filtering, scoring, de-duplication, mixing, sharding and packing.

Nothing else in the library imports this subpackage.
"""
