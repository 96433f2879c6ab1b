"""functions of the reconciliation library."""
