"""Whole-run jobs and the join and scratch helpers they share."""
