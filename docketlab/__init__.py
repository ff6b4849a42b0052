"""Evidence-grounded document review analytics on Spark."""
