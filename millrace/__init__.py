"""Text-data preparation and model evaluation as Spark plans."""
