"""Post-processing, memory planning and small utilities."""
