"""Building blocks that several operators share: shared-folder tables, global ranks, components."""
