"""The peptide caller of one transcript: plain Python, run inside a grouped Spark task."""
