"""calibrant: distillation and evaluation analytics on PySpark DataFrames."""
