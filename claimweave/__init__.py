"""Prior-art evidence analysis as Spark DataFrame operators."""
