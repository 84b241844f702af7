"""Whole plans: the static pipeline and the query catalogue."""
