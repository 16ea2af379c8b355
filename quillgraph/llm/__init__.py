"""Training-data operators. Nothing else in quillgraph imports this subpackage."""
