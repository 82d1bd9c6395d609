"""Code-fact and text-corpus analytics as plain Spark DataFrame plans."""
