"""Named queries over the bound tables."""
