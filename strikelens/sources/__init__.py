"""Readers, normalisers, sinks, and the demo tables the registered queries use."""
