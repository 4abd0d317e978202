"""Operators for preparing training text. Nothing else in lanegraph imports this subpackage."""
