"""graphquarry streaming."""
