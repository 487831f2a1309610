"""Part of the strandline engine."""
