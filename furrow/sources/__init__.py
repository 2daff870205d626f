"""Where layers come from: files, schemas, coordinate systems."""
