"""Operators for training-text corpora.  Nothing else in quillspark imports this subpackage."""
