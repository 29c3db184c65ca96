"""Named operators on fleet tables: DataFrame in, DataFrame out, nothing executed."""
