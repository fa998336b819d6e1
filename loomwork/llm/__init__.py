"""Operators for training-data pipelines.  Nothing else in loomwork imports this subpackage."""
