"""revsift: which cached embedding vectors of a versioned code base are stale, and what each answer costs, on PySpark."""
