"""operators of the reconciliation library."""
