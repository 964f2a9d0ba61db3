"""Column builders. Everything here returns a ``pyspark.sql.Column`` and stays
inside whole-stage codegen (built-in expressions only, no Python UDFs)."""
