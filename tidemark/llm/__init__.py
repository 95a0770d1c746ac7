"""Operators for preparing training data from text at scale. Nothing else in the package imports this one."""
