"""Operators for text corpora: token ids, packing, language. Nothing else in the library imports this subpackage."""
