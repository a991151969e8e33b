"""Column-expression builders: geometry, projections, text rules and fixed tables."""
