"""Column helpers: sums, options, results, strict parsing, wrapping integers."""
