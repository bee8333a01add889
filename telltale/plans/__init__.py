"""Jobs: whole pipelines from source tables to written results."""
