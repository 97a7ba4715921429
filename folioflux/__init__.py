"""folioflux: a document and records analytics engine on PySpark DataFrames and SQL."""
