"""Loss-reserving jobs on Spark, and (in the optional subpackage ``llm``) corpus-preparation jobs."""
