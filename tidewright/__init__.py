"""Tidewright: a Spark-first layered warehouse for change records, logs and corpora."""
