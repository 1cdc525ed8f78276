"""Column expressions: greeks, price picking, time and coverage helpers."""
