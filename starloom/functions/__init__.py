"""starloom subpackage."""
