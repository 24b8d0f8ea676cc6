"""graphquarry functions."""
