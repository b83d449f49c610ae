"""Graph facts, rules, traversals and reports as DataFrame operators."""
