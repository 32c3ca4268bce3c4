"""Training-data operators: media, scoring, packing, sharding, joins, search and mixing.

Nothing outside this subpackage imports it.
"""
