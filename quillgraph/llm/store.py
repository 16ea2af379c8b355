"""Written tables in the shared checkpoint folder."""

from quillgraph.store import dropped, freed, shared_dir, written

__all__ = ["dropped", "freed", "shared_dir", "written"]
