"""Media analytics on Spark: media objects, records, samples, pixels and bitstream syntax as DataFrames."""
