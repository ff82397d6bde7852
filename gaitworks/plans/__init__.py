"""Whole jobs: from recordings to a dataset, from a dataset to a derived one."""
