"""Search-visibility and site-audit analytics as PySpark DataFrame operators."""
