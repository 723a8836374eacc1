"""Analytics over UTXO ledgers as Spark jobs: DataFrames in, DataFrames out."""
