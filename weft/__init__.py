"""weft: entity resolution and corpus preparation as Spark DataFrame plans."""
