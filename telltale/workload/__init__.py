"""Registered queries over the test tables, and the same results written as plain SQL."""
