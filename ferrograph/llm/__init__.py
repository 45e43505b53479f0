"""Operators for training-data pipelines: text in, decisions and statistics out, one module an operator."""
