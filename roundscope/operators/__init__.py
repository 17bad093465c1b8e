"""DataFrame operators over message tables."""
