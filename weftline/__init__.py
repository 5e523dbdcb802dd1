"""Weftline: Spark-first preparation and evaluation of conversational and speech corpora."""
