"""Column-level building blocks: fixed vocabularies and native expressions."""
