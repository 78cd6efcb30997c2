"""Operators for preparing training data; each module's docstring states its method and its edge cases."""
