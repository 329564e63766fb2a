"""wattmill: industrial-energy analytics as Spark jobs. Every operator takes and returns DataFrames."""
