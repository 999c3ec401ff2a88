"""Named queries over the sample tables, and SQL that gives the same rows."""
