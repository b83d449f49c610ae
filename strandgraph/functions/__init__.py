"""Column functions over identifiers, paths and text."""
