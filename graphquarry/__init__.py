"""graphquarry: property-graph, search and data-preparation operators on Spark DataFrames."""
