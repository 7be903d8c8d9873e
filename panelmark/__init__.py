"""Spark jobs for auditing labelled corpora: panel labels, agreement, resampling, calibration history."""
