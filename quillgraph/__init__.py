"""quillgraph: corpus-scale document graphs as Spark DataFrame programs."""
