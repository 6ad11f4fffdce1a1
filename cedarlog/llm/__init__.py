"""Training-data operators. Nothing outside this package (but the guarded import in ``__spark_entry__``) imports it."""
