"""Plan helpers: sessions, lineage cuts and size-checked broadcasts."""
