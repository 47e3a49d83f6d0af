"""The layers as DataFrame plans, and the registered queries with their SQL."""
