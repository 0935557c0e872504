"""See the package docstring of weftline."""
