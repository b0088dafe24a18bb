"""Operators for preparing language-model training text at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers one query per operator and the corpus pipeline.
"""
