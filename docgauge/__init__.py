"""Document quality control on Spark: DataFrame operators, a rule engine, and streaming state."""
