"""Knowledge-graph construction, alignment, evaluation and evolution on PySpark DataFrames."""
