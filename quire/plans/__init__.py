"""Plan helpers shared by operators: sessions, lineage cuts, global order."""
