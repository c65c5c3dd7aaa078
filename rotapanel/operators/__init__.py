"""Survey operators: weights, calibration, estimation, panels and flows."""
