"""Sports-results analytics on Spark: every public function takes a session or DataFrames and returns a DataFrame."""
