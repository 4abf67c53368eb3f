"""Operators for text used to train language models; nothing else in the library imports this subpackage."""
