"""Named queries: operators applied to whole catalogue tables, with their oracle SQL."""
