"""Jobs, reports, settings search and evaluation built from the operators."""
