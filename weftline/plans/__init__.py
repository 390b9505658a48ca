"""Ways to run a topology over a DataFrame."""
