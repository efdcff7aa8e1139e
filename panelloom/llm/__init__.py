"""Operators of a training-data pipeline: join, format, mix, score, pack, shard, filter, dedup, encode, search."""
