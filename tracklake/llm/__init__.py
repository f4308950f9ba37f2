"""Operators for preparing training text: one module per operator.

``registry`` holds the thin queries and their SQL; nothing outside this
subpackage imports it.
"""
