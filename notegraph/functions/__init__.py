"""Values of records, as Spark columns and as the small Python helpers of the parser."""
