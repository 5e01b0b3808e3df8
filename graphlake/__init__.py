"""graphlake: property-graph, vector and knowledge-graph analytics as Spark DataFrame plans."""
