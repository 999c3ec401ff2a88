"""Sample PDF files, built without any of the package's own readers or writers."""
