"""starloom: RDF statement processing expressed on the Spark DataFrame API."""
