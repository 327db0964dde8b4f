"""loomgraph: text-derived knowledge graphs, retrieval and ranking metrics as PySpark DataFrame operators."""
