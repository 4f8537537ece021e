"""See the package docstring of stanzaflow."""
