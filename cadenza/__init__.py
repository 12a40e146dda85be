"""Trial-level signal and mixed-effects analytics as Spark DataFrame operators."""
