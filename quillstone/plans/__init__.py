"""Plans: fixtures derived from the star schema, the extraction pipeline, reports, and the registered queries."""
