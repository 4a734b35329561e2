"""Evidence analytics on Spark: facts, profiles, three-state rules, ranked and explained scores."""
