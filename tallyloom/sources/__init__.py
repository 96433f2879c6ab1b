"""sources of the reconciliation library."""
