"""Column functions that Spark lacks, as compositions of its own."""
