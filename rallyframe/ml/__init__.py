"""Model fitting, calibration and metrics."""
