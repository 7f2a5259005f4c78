"""Named queries with their SQL twins, and pipelines of several operators."""
