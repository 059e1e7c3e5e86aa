"""Writing predictions, samples, metrics and models."""
