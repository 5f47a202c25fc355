"""Personal-data exports as DataFrames: readers, one library of typed tables, and the questions asked of it."""
