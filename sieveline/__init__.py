"""A PySpark engine that measures and reduces the text that tools put into model conversations."""
