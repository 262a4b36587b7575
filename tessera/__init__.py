"""tessera: a small SQL dialect and a set of data-preparation operators on PySpark."""
