"""Session settings and lineage control shared by the operators."""
