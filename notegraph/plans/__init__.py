"""Field resolution and the predicate language, compiled to Spark columns."""
