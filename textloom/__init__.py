"""textloom: document-text analytics expressed as Spark DataFrame plans."""
