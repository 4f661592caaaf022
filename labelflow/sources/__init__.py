"""labelflow.sources."""
