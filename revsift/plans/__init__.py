"""Registered queries: each module has QUERIES (name -> (spark, sf_dir) -> DataFrame) and SQL (name -> equivalent SQL)."""
