"""Column functions: text parsing, dates, tile names, geodesy and array lookups."""
