"""graphquarry plans."""
