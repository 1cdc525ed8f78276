"""Whole jobs: snapshot to metrics, tape to flow metrics, and the serving queries."""
