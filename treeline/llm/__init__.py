"""Operators for training-data pipelines over source code and documents.

Nothing outside this subpackage imports it; the package can be deleted whole.
"""
