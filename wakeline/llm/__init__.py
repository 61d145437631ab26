"""Operators for training-data pipelines. Nothing outside this folder imports them; the entry module adds their
queries only where this subpackage is there."""
