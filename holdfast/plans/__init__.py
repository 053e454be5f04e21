"""Multi-step studies composed from the operators."""
