"""The pipelines kept current from arriving files."""
