"""Layered dataflow on Spark: workflows of named nodes evaluated for many runs at once."""
