"""DataFrame operators: profiling, derivation, discovery, triage and key-value state."""
