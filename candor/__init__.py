"""candor: media-forensics scoring and evaluation as Spark DataFrame pipelines."""
