"""Spark-native analytics over long, segmented video transcripts.

Every operator takes and returns DataFrames and builds a lazy plan; nothing here
starts a session or reads a path by itself except ``kinolake.sources``.
"""
