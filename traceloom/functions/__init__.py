"""Part of the traceloom engine."""
