"""Column-level helpers: naming rules, message codec, null-safe joins."""
