"""Driver-side plans over small layer metadata."""
