"""graphquarry operators."""
