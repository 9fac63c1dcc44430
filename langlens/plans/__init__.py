"""The registered queries of the engine and their SQL."""
