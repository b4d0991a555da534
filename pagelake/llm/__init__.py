"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; `__spark_entry__` adds its queries when it is there.
"""
