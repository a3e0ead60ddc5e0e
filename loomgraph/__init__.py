"""loomgraph: evolving-graph analytics as PySpark DataFrame programs."""
