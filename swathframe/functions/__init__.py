"""Column builders: no DataFrames, no actions, no Python UDFs."""
