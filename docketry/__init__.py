"""Document review as Spark jobs: each function takes and returns DataFrames."""
