"""Panel research operators for Spark: DataFrame in, DataFrame out, keyed by instrument, series or variant."""
