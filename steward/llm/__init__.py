"""Operators for preparing language-model training data.

Nothing outside this folder imports it; delete the folder and the rest still works.
"""
