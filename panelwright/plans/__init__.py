"""Looking at physical plans."""
