"""DataFrame operators: lags, fits, predictions, scores, serving, drift."""
