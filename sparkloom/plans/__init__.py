"""Named queries by topic; each module fills the registry."""
