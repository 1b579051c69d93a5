"""Writers of tables and diagrams."""
