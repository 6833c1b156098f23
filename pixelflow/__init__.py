"""Region-aware colour quantization and image-quality analytics on Spark DataFrames."""
