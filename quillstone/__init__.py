"""quillstone: corpus, retrieval and evidence operators as Spark DataFrame plans."""
