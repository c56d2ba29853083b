"""Operators that prepare texts for the training of language models. Nothing outside this subpackage imports it."""
