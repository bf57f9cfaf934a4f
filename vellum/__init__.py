"""Documents as relational data on Spark: extraction, layout, redaction and insertion."""
