"""Column expressions, and lineage cutting."""
