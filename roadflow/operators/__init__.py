"""DataFrame operators; every public function maps DataFrames to DataFrames."""
