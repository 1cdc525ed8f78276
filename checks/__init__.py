"""Registered queries over the shared tables, and the SQL they must agree with."""
