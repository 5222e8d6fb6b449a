"""Column functions: colour, blending and adjustments."""
