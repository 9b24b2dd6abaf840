"""Operators for text corpora and their queries; nothing else of the library imports this package."""
