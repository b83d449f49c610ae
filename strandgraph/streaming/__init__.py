"""Structured Streaming forms of the change queries; an extension."""
