"""plans of the reconciliation library."""
