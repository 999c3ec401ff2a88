"""Reading and writing PDF bytes in plain Python: no Spark in here."""
