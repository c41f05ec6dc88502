"""Test-table binding and the registered queries with their SQL twins."""
