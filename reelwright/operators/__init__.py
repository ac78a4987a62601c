"""DataFrame operators. Inputs and outputs are DataFrames; nothing is collected."""
