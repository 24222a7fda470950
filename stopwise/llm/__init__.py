"""Operators for preparing training text at cluster scale.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
