"""Adaptive forecasting of multivariate series in tables and streams, on Spark."""
