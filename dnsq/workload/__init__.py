"""Registered queries over the given tables, which stand in for logs, packets and labelled sets."""
