"""Image, mask and window analytics as Spark DataFrame plans."""
