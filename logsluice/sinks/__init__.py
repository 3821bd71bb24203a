"""Writers of delivered records."""
