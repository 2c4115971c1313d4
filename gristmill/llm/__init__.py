"""Training-data operators.  Nothing outside this subpackage imports it, save ``__spark_entry__`` (guarded)."""
