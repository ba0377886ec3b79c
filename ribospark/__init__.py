"""ribospark: proteogenomics and corpus analytics expressed as Spark DataFrame plans."""
