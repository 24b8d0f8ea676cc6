"""graphquarry sources."""
