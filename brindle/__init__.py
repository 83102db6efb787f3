"""brindle: JSON search-and-aggregation requests over columnar tables, on PySpark."""
