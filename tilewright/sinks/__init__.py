"""Writers of the result tables."""
