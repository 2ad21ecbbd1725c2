"""Operators that prepare web text for language-model training.

Nothing outside this subpackage imports it; ``weirflow.llm.queries`` registers its queries.
"""
