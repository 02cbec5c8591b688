"""quillon: prose analytics over documents, expressed as Spark DataFrame plans."""
