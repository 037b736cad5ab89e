"""Source schemas, loaders and the sample tables used for checks."""
