"""End-to-end runs: validate, compare with the stored version, decide, write, index."""
