"""Plans: the semantic layer, the star-schema assembly, and named business queries."""
