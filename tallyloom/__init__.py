"""tallyloom: statement reconciliation analytics as Spark DataFrame programs."""
