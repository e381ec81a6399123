"""Operators for preparing large text corpora; nothing else in statloom imports this subpackage."""
