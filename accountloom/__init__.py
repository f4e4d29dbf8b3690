"""Company screening from published accounts, as Spark DataFrame dataflows."""
