"""Operators of a training-data pipeline: packing, sharding, media, near duplicates, models, filters.

Nothing outside this folder imports it.  ``queries.QUERIES`` and ``queries.ORACLES`` hold the
registered queries.
"""
