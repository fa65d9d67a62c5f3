"""lodestar: evidence retrieval, grounding checks and evaluation statistics as Spark plans."""
