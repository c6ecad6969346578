"""Annotation analytics on Spark: boxes, matching, measures, ordered operators, sampling and tiles."""
