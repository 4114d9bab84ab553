"""Sources: schemas of the data model, file listings, and bindings to tables."""
