"""Part of lanegraph."""
