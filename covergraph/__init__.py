"""covergraph: covers of point clouds and their overlap graphs as DataFrame operations."""
