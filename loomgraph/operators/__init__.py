"""Graph operators: access, traversal, ranking, components, triangles, statistics."""
