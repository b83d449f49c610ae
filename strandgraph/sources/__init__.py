"""Adapters that turn tables, Markdown, source code and change sets into facts."""
