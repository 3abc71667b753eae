"""Where object graphs come from: heap dumps and relational tables."""
