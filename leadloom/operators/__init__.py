"""DataFrame -> DataFrame operators, one module per stage of the lead pipeline."""
