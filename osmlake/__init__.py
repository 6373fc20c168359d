"""A versioned OpenStreetMap-style database on Spark: points, ways and relations, kept current from change files."""
