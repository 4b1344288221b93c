"""Operators for building training corpora; nothing else in plaszcz imports this subpackage."""
