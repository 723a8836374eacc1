"""The ledger view over the star-schema tables, the query registry and its SQL."""
